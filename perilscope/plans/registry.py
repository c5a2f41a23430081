"""All registered queries; importing the modules fills the catalog."""

from perilscope.plans import explain, features, oneway, scores, streams, tables, training  # noqa: F401
from perilscope.plans.catalog import ORACLES, QUERIES  # noqa: F401
