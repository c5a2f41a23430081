"""BPE encoding by tree concatenation, and decoding.

A long text is halved until its leaves have at most ``LEAF_BYTES``; the leaves of
all texts of a batch are encoded side by side, whatever stands at their borders.
At every join the text around it is encoded anew in a window that grows until
its tokens agree exactly, on both sides, with those of the two halves; what lies
between the agreeing tokens is taken from the window. Where a join falls between
two units that can never share a token, the halves agree at once.

Why this is exact: the tokenizer splits at white space, and between ASCII
letters, digits and other ASCII signs (an apostrophe excepted), whatever stands
further away, so units between such borders can be encoded one by one. Inside an
unbroken unit, BPE tokens are right as soon as each neighbouring pair of tokens
is; a token that window and half share makes the pair across the border
one of the window's pairs.

A unit is encoded by the tokenizers library once and then found in a table of
fixed size by the hash of its bytes, of which two of 64 bits with different seeds must
agree; a table entry that is taken by another unit is overwritten, which costs time and
changes no result.

Defined results: a null text is encoded like an empty one, without tokens; repeated texts
are encoded again; other columns pass through, those named like the added ones are replaced.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from perilscope.llm import words as W

LEAF_BYTES = 8192
WINDOW = 64  # characters on either side of a join at first
WHOLE = 512  # an unbroken unit up to so many bytes is one window
SLOTS = 1 << 20
STORE_IDS = 4_000_000  # token ids held for known units; beyond, the table starts anew

#: Fixed value: the pattern and steps for which the rule about units holds.
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

# byte classes: 0 white space, 1 letter, 2 digit, 3 other sign, 4 apostrophe, 5 beyond ASCII or not to be split
_CLASS = np.full(256, 3, dtype=np.uint8)
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[48:58] = 2
_CLASS[39] = 4
_CLASS[128:] = 5
_SPLITS = np.zeros((6, 6), dtype=bool)
for _a in (1, 2, 3):
    for _b in (1, 2, 3):
        _SPLITS[_a, _b] = _a != _b
_SPLITS[0, :] = _SPLITS[:, 0] = True
_SPLITS = _SPLITS.reshape(-1)


class Encoder:
    """Encodes rows of bytes; holds the tokenizer and the table of known units."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if steps != ["NFC", "Replace", "Lowercase"] or split["pattern"] != {"Regex": PATTERN} or level["add_prefix_space"]:
            raise ValueError("the rule about units is only known to hold for the word BPE tokenizer")
        if spec["decoder"] is not None or any(not x["content"].startswith("<|") for x in spec["added_tokens"]):
            raise ValueError("a decoder or a special token of another form")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.names = np.array(names, dtype=object)
        self.ends_word = np.array([n.endswith("</w>") for n in names])
        self._forget()

    def _forget(self) -> None:
        self.slot_key = np.zeros(SLOTS, dtype=np.uint64)
        self.slot_check = np.zeros(SLOTS, dtype=np.uint64)
        self.slot_unit = np.zeros(SLOTS, dtype=np.int32)
        self.ids = np.zeros(1 << 20, dtype=np.int32)
        self.n_ids = 0
        self.first = np.zeros(1 << 18, dtype=np.int64)
        self.count = np.zeros(1 << 18, dtype=np.int32)
        self.n_units = 0

    def _store(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n_units + len(counts) > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        new = slice(self.n_units, self.n_units + len(counts))
        ends = np.cumsum(counts)
        self.first[new] = self.n_ids + ends - counts
        self.count[new] = counts
        self.n_ids += len(ids)
        self.n_units += len(counts)
        return np.arange(new.start, new.stop)

    def _encode_strings(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each text. Many short texts go to the library in lines of 64;
        a line counts only if every text of it ended exactly one word."""
        plain = [k for k, t in enumerate(texts) if t.isalpha()]
        lines = [plain[i : i + 64] for i in range(0, len(plain), 64)]
        parts: list = [None] * len(texts)
        rest = [k for k, t in enumerate(texts) if not t.isalpha()]
        for line, found in zip(lines, self._library([" ".join(texts[k] for k in line) for line in lines])):
            ids = np.array(found, dtype=np.int32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(line):
                rest += line
                continue
            for k, part in zip(line, np.split(ids, ends[:-1])):
                parts[k] = part
        for k, found in zip(rest, self._library([texts[k] for k in rest])):
            parts[k] = np.array(found, dtype=np.int32)
        counts = np.array([len(p) for p in parts], dtype=np.int64)
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), counts

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _units(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of every unit, after encoding those that are not known."""
        if self.n_ids > STORE_IDS:
            self._forget()
        keys, checks = W.hashes(raw, starts, ends), W.hashes(raw, starts, ends, seed=7)
        keys[keys == 0] = 1
        slots = (keys & np.uint64(SLOTS - 1)).astype(np.int64)
        units = self.slot_unit[slots].astype(np.int64)
        unknown = np.flatnonzero((self.slot_key[slots] != keys) | (self.slot_check[slots] != checks))
        if len(unknown):
            order = unknown[np.lexsort((checks[unknown], keys[unknown]))]
            new = np.ones(len(order), dtype=bool)
            new[1:] = (keys[order[1:]] != keys[order[:-1]]) | (checks[order[1:]] != checks[order[:-1]])
            pick = order[new]
            whole = raw.tobytes()
            texts = [whole[a:b].decode("utf-8", "replace") for a, b in zip(starts[pick].tolist(), ends[pick].tolist())]
            numbers = self._store(*self._encode_strings(texts))
            units[order] = numbers[np.cumsum(new) - 1]
            slots = slots[pick]
            self.slot_key[slots], self.slot_check[slots], self.slot_unit[slots] = keys[pick], checks[pick], numbers
        return units

    def encode(self, data: np.ndarray, offsets: np.ndarray, leaf: int = LEAF_BYTES) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all rows, and where each row's begin."""
        kind = _CLASS[data]
        signs = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)) if len(data) > 1 else []
        text = W.lowered(data)
        if len(signs):  # a special token may stand here: keep case, split at white space only
            for row in np.unique(np.searchsorted(offsets, signs, side="right") - 1).tolist():
                part = slice(int(offsets[row]), int(offsets[row + 1]))
                kind[part] = np.where(kind[part] == 0, 0, 5)
                text[part] = data[part]
        cuts = _leaf_cuts(data, offsets, leaf)
        starts, ends = _unit_spans(kind, np.concatenate([offsets, cuts]))
        units = self._units(text, starts, ends)
        first, count = self.first[units], self.count[units].astype(np.int64)
        if len(cuts):
            self._join_leaves(data, text, kind, cuts, starts, ends, first, count)
        out = self.ids[W.ragged(count, first)]
        total = np.concatenate([[0], np.cumsum(count)])
        return out, total[np.searchsorted(starts, offsets, side="left")]

    def _join_leaves(self, data, text, kind, cuts, starts, ends, first, count) -> None:
        """Replace the tokens of units that a leaf's border divides."""
        left = np.searchsorted(ends, cuts, side="left")
        right = left + 1
        inside = right < len(starts)
        inside[inside] = (ends[left[inside]] == cuts[inside]) & (starts[right[inside]] == cuts[inside])
        inside[inside] &= ~_SPLITS[kind[cuts[inside] - 1].astype(np.int64) * 6 + kind[cuts[inside]]]
        group: list[int] = []
        divided = list(zip(cuts[inside].tolist(), left[inside].tolist()))
        for k, (cut, unit) in enumerate(divided):
            group.append(cut)
            if k + 1 < len(divided) and divided[k + 1][1] == unit + 1:
                continue  # the next leaf is part of the same unbroken unit
            u0, u1 = unit + 1 - len(group), unit + 2
            begin, end = int(starts[u0]), int(ends[u1 - 1])
            ids = self.concatenate(text[begin:end].tobytes(), [c - begin for c in group])
            (number,) = self._store(ids, np.array([len(ids)]))
            first[u0], count[u0] = self.first[number], len(ids)
            count[u0 + 1 : u1] = 0
            group = []

    def concatenate(self, raw: bytes, cuts: list[int], window: int = WINDOW, whole: int = WHOLE) -> np.ndarray:
        """Ids of one unbroken piece of text from its parts between ``cuts`` (byte places)."""
        text = raw.decode("utf-8", "replace")
        if len(raw) <= whole or _composes(text):
            return np.array(self._library([text])[0], dtype=np.int32)
        edges = [0, *[len(raw[:c].decode("utf-8", "replace")) for c in cuts], len(text)]
        spans = list(zip(edges, edges[1:]))
        found = self.tokenizer.encode_batch([text[a:b] for a, b in spans], add_special_tokens=False)
        nodes = [_Node(a, b, e.ids, [(x + a, y + a) for x, y in e.offsets]) for (a, b), e in zip(spans, found)]
        while len(nodes) > 1:
            pairs = [self._join(text, *nodes[i : i + 2], window) for i in range(0, len(nodes) - 1, 2)]
            nodes = pairs + ([nodes[-1]] if len(nodes) % 2 else [])
        return np.array(nodes[0].ids, dtype=np.int32)

    def _join(self, text: str, left: _Node, right: _Node, window: int) -> _Node:
        cut = left.end
        while True:
            a, b = max(left.begin, cut - window), min(right.end, cut + window)
            e = self.tokenizer.encode(text[a:b], add_special_tokens=False)
            middle = _Node(a, b, e.ids, [(x + a, y + a) for x, y in e.offsets])
            if a == left.begin:
                i = m = 0
            else:
                i, m = left.agreement(middle, a + 1, cut - 1, last=False)
            if b == right.end:
                j, n = len(right.ids), len(middle.ids)
            else:
                j, n = right.agreement(middle, cut + 1, b - 1, last=True)
            if i >= 0 and j >= 0 and m <= n:
                return _Node(
                    left.begin,
                    right.end,
                    left.ids[:i] + middle.ids[m:n] + right.ids[j:],
                    left.spans[:i] + middle.spans[m:n] + right.spans[j:],
                )
            if a == left.begin and b == right.end:
                return middle
            window *= 2


class _Node:
    """Tokens of ``text[begin:end]``, with their character spans."""

    def __init__(self, begin: int, end: int, ids: list[int], spans: list[tuple[int, int]]):
        self.begin, self.end, self.ids, self.spans = begin, end, ids, spans

    def clean(self, k: int) -> bool:
        """The token begins and ends between characters."""
        a, b = self.spans[k]
        before = self.spans[k - 1][1] if k else self.begin
        after = self.spans[k + 1][0] if k + 1 < len(self.ids) else self.end
        return a < b and before <= a and b <= after

    def agreement(self, other: _Node, low: int, high: int, last: bool) -> tuple[int, int]:
        """Places of one token that both have, inside [low, high]; (-1, -1) without one."""
        mine: dict = {}
        k = len(self.ids) - 1 if not last else 0
        step = 1 if last else -1
        while 0 <= k < len(self.ids):
            a, b = self.spans[k]
            if (last and a > high) or (not last and b < low):
                break
            if a >= low and b <= high and self.clean(k):
                mine[(a, b, self.ids[k])] = k
            k += step
        order = range(len(other.ids)) if not last else range(len(other.ids) - 1, -1, -1)
        for m in order:
            k = mine.get((*other.spans[m], other.ids[m]))
            if k is not None and other.clean(m):
                return k, m
        return -1, -1


def _composes(text: str) -> bool:
    """Some character could join with or move around another: such a piece is encoded whole."""
    return any(unicodedata.combining(c) or "ᄀ" <= c <= "ᇿ" or unicodedata.category(c)[0] == "M" for c in text)


def _leaf_cuts(data: np.ndarray, offsets: np.ndarray, leaf: int) -> np.ndarray:
    """The inner borders of all leaves: halves of halves, moved to the next whole character."""
    sizes = np.diff(offsets)
    cuts: list[np.ndarray] = []
    for row in np.flatnonzero(sizes > leaf).tolist():
        size = int(sizes[row])
        parts = 1 << (-(-size // leaf) - 1).bit_length()
        at = offsets[row] + np.arange(1, parts, dtype=np.int64) * size // parts
        for _ in range(3):
            at = at + ((data[np.minimum(at, len(data) - 1)] & 0xC0) == 0x80)
        cuts.append(at[at < offsets[row + 1]])
    return np.unique(np.concatenate(cuts)) if cuts else np.zeros(0, np.int64)


def _unit_spans(kind: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(kind)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.empty(n + 1, dtype=bool)
    border[0] = border[n] = True
    border[1:n] = _SPLITS[kind[:-1].astype(np.int16) * 6 + kind[1:]]
    border[breaks] = True
    at = np.flatnonzero(border)
    starts, ends = at[:-1], at[1:]
    text = kind[starts] != 0
    return starts[text], ends[text]


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and tokenizer file, until a task of another operator needs the memory."""
    return W.kept(f"encoder {path}", lambda: Encoder(path))


#: Columns ``encode_texts`` can add.
ADDED = {
    "n_tokens": (T.LongType(), pa.int64()),
    "tokens": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    "ids_sha256": (T.StringType(), pa.string()),
    "decoded": (T.StringType(), pa.string()),
    "decoded_sha256": (T.StringType(), pa.string()),
}


def encode_texts(
    docs: DataFrame, path: str, text: str = "text", add: tuple[str, ...] = ("n_tokens", "tokens"), keep_text: bool = True,
    leaf: int = LEAF_BYTES,
) -> DataFrame:
    """``docs`` with columns out of ``ADDED``, for the tokenizer file ``path`` (on every machine)."""
    docs = docs.drop(*[c for c in add if c != text])
    kept = [f for f in docs.schema.fields if keep_text or f.name != text]
    schema = T.StructType([*kept, *[T.StructField(c, ADDED[c][0]) for c in add]])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch, data, offsets in W.batches(stream, text):
            ids, first = own.encode(data, offsets, leaf)
            bounds = first.tolist()
            spans = list(zip(bounds, bounds[1:]))
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            decoded = None
            if {"decoded", "decoded_sha256"} & set(add):
                decoded = [" ".join(own.names[ids[a:b]].tolist()) for a, b in spans]
            for c in add:
                if c == "n_tokens":
                    values = np.diff(first)
                elif c == "tokens":
                    columns.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32())))
                    continue
                elif c == "ids_sha256":
                    little = ids.astype("<u4")
                    values = [hashlib.sha256(little[a:b]).hexdigest() for a, b in spans]
                elif c == "decoded":
                    values = decoded
                else:
                    values = [hashlib.sha256(d.encode()).hexdigest() for d in decoded]
                columns.append(pa.array(values, ADDED[c][1]))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def decode_tokens(tokens: DataFrame, path: str, column: str = "tokens", into: str = "decoded") -> DataFrame:
    """The text of each row's ids, special tokens included; null for null ids."""
    tokens = tokens.drop(into)
    schema = T.StructType([*tokens.schema.fields, T.StructField(into, T.StringType())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = encoder(path).names
        for batch in stream:
            values = batch.column(batch.schema.get_field_index(column))
            flat, where = values.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(values.value_lengths().fill_null(0))])
            texts = [None if not values[i].is_valid else " ".join(names[flat[where[i] : where[i + 1]].astype(np.int64)].tolist()) for i in range(len(values))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[f.name for f in schema.fields])

    return tokens.mapInArrow(run, schema)
