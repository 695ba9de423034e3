"""Near-duplicate lines by an exact set-similarity join; of two that match, the later one goes.

A line is the set of its words (cut at white space, in lower case). Two lines match if their Jaccard similarity is at
least the threshold. A line with words is removed if any earlier line of the corpus matches it, removed itself or not;
earlier means a smaller document id, then a smaller place in the document.

1. Words are counted over the whole corpus in a table of fixed size. Rarity and hash together order all words.
2. Each line gives postings for its prefix: the n - ceil(t n) + 1 rarest words. Lines that match share one of them.
   (A line so short that only an equal set can match it has one posting, for the set.) Postings travel as packed blocks,
   dealt by word. Of the lines of one block that have the same words, the earliest sends postings; words are compared.
3. Where the postings of a word meet, a line whose signature equals that of an earlier one becomes a pair with the last
   such line before it. For the others the length filter, the positional filter and a bound on the words that differ
   (by parities of hash bits) leave candidates; the earliest go on, up to one that is hardly wrong or to LISTED of them,
   and a sign if there are more.
4. All pairs are verified on the lines' words: first the pairs of like signatures and one candidate of each line,
   then, where it failed, its other candidates. Lines for which all failed and that have more are looked for in
   all texts, or, if they are many, go through steps 2 to 4 again, now with all of their candidates. If two lines of
   like signatures turn out to differ, everything is done again without signatures. So no line is removed without a
   match, none that has one is kept, and a group of many near copies isn't spelt out in pairs. (Words are told apart by
   64 bits in the filters: two words of one line with equal hashes could hide a match, never make one.)

The joins that fetch the words of lines are plain shuffles of a line's key, so Spark splits the key of a line that many
others are compared with.

Defined cases: null and empty texts have no lines to remove and stay as they are; a text whose lines all go becomes
empty; lines without words stay. U+0000 is white space. A null id comes after all others. Rows of one id are ordered by
a hash of their texts; rows alike in both count as one document and lose the same lines. No rows give no rows. Further
columns are passed on; `n_lines` and `n_removed` of the input give way to those of the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgaudit.llm.memory import lean, slices
from kgaudit.llm.shingles import bitmap, hits, mix
from kgaudit.session import discard, materialize, release, width

CELLS = 1 << 21
_CHUNK = 1 << 16
_TOP = (1 << 20) - 1
_LAST = (1 << 63) - 1
_POSTING = {"word": "<u8", "doc": "<i8", "pos": "<i8", "odd": "<u8", "set": "<u4", "n": "<u4", "i": "<u4"} | {f"wide{k}": "<u8" for k in range(4)}
#: Besides parities of 64 hash bits all lines have those of 64 others, lines of more words than this of 256.
_LONG = 64
#: A line's candidates for a word are listed up to the first that differs by less than SURE of what it may, and up to
#: LISTED of them; the others are only fetched for lines that need them.
LISTED = 64
#: Up to so many lines (and FEW_BYTES of them) that need the rest of their candidates are looked for by one more pass
#: over the texts, with these lines broadcast. More of them take the way of all lines.
FEW_LINES, FEW_BYTES = 2000, 4 << 20
SURE = 0.4
#: Bytes of text that are hashed at once, that are sorted at once, and that share a block of postings.
_HASHED, _SORTED, _BLOCK = 1 << 18, 1 << 20, 1 << 22
_LINE = np.dtype([("doc", "<i8"), ("pos", "<i8")])
_GAP = re.compile("[\\x00-\\x20]+")


_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo two to the 64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, _HASHED)
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, x, np.uint64)], dtype=np.uint64) for x in (_BASE, inverse)]
    return _POWERS[0][:n], _POWERS[1][:n]


def _word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A word's hash is a difference of running sums of bytes times powers, moved back to the start; the sums run over
    chunks of whole words."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        base = int(starts[a])
        b = max(a + 1, int(np.searchsorted(ends, base + _HASHED, "right")))
        part = raw[base : ends[b - 1]]
        up, down = _powers(len(part))
        sums = np.cumsum(part * up, dtype=np.uint64)
        s, e = starts[a:b] - base, ends[a:b] - base
        before = np.where(s > 0, sums[s - 1], np.uint64(0))
        out[a:b] = mix(mix((sums[e - 1] - before) * down[s]) + (e - s).astype(np.uint64))
        a = b
    return out


class _Cut:
    """The words of a batch of texts, found and hashed on the bytes of all texts at once."""

    def __init__(self, texts: pa.Array) -> None:
        low = [b"" if t is None else t.lower() if t.isascii() else t.decode().lower().encode() for t in texts.cast(pa.binary()).to_pylist()]
        self.raw = raw = np.frombuffer(b"\n".join([*low, b""]), np.uint8)
        self.begin = np.cumsum([0, *(len(t) + 1 for t in low)])[:-1]
        del low
        gap = raw <= 32
        edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if len(raw) and not gap[0]:
            edges = np.r_[0, edges]
        self.starts, ends = edges[::2], edges[1::2]  # the last sign is a line's end, so each word has one
        self.hashes = _word_hashes(raw, self.starts, ends)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The line of each word, and each line's text and number; lines without words are left out. Texts are told
        apart by where they begin."""
        breaks = np.flatnonzero(self.raw == 10)
        line = np.searchsorted(breaks, self.starts)  # lines of all texts, numbered on
        first_line = np.searchsorted(breaks, self.begin)
        new = np.r_[True, line[1:] != line[:-1]] if len(line) else np.zeros(0, bool)
        owner = np.searchsorted(first_line, line[new], "right") - 1
        return np.cumsum(new) - 1, owner, line[new] - first_line[owner]


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a batch of texts, the line of each, and each line's text and number."""
    cut = _Cut(texts)
    return cut.hashes, *cut.lines()


def _words(line: str) -> set[str]:
    """The words of one line, as _hashed cuts them: at bytes up to the space."""
    return set(_GAP.split(line.lower())) - {""}


def word_counts(rows: DataFrame) -> Broadcast:
    """How often the words of each cell occur in the whole corpus. Tasks add up their own cells; chunks of the table
    are then summed apart, one row after another."""
    spark = rows.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.uint32)
        for batch in batches:
            for b in slices(batch, _SORTED):
                h = _Cut(b.column(b.num_columns - 1)).hashes
                np.add.at(total, (h & np.uint64(CELLS - 1)).astype(np.int64), np.uint32(1))
        pack = zstandard.ZstdCompressor(1)
        at = [k for k in range(CELLS // _CHUNK) if total[k * _CHUNK : (k + 1) * _CHUNK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([pack.compress(total[k * _CHUNK : (k + 1) * _CHUNK].tobytes()) for k in at], pa.binary())], names=["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for k, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(unpack.decompress(c), np.uint32).astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(x, _TOP).astype(np.uint32).tobytes() for x in sums.values()], pa.binary())], names=["chunk", "counts"])

    out = np.zeros(CELLS, np.uint32)
    for r in rows.select("text").mapInArrow(lean(count), "chunk int, counts binary").repartition(CELLS // _CHUNK, "chunk").mapInArrow(lean(add), "chunk int, counts binary").collect():
        out[r["chunk"] * _CHUNK : (r["chunk"] + 1) * _CHUNK] = np.frombuffer(bytes(r["counts"]), np.uint32)
    return spark.sparkContext.broadcast(out)


def _line_ids(doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """One hash for a line's identity, for bitmaps."""
    return mix(mix(doc.astype(np.uint64)) + pos.astype(np.uint64)).astype(np.int64)


def _batch_ids(b: pa.RecordBatch) -> np.ndarray:
    return _line_ids(b.column(0).to_numpy(), b.column(1).to_numpy())


class _Lines:
    """The lines of a batch (doc, tie, text) that have words: word order numbers sorted within each line, the line of
    each, and of the lines document, place, text and number in it, size, hash of the set, and parities: bit b tells
    whether an odd number of its words hash to b."""

    def __init__(self, b: pa.RecordBatch, counts: np.ndarray, only: np.ndarray | None = None) -> None:
        h, line, owner, number = _hashed(b.column(2))
        word = (counts[(h & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20))
        if only is not None:  # lines without any of the asked words are left out early
            some = np.zeros(len(owner), bool)
            some[line[hits(only, word.astype(np.int64))]] = True
            word, h, line = word[some[line]], h[some[line]], line[some[line]]
        if len(owner) < 1 << 16:  # by line and the first 48 bits of the word, in one sort
            key = line.astype(np.uint64) << np.uint64(48) | word >> np.uint64(16)
            order = np.argsort(key)
            key = key[order]
            same = key[1:] == key[:-1]
        else:
            order = np.lexsort((word, line))
            same = (word[order][1:] == word[order][:-1]) & (line[order][1:] == line[order][:-1])
        in_order = word[order], h[order], line[order]
        if (in_order[1][1:][same] != in_order[1][:-1][same]).any():  # words that share an order number: their hashes decide
            order = np.lexsort((h, word, line))
            in_order = word[order], h[order], line[order]
            same = (in_order[1][1:] == in_order[1][:-1]) & (in_order[2][1:] == in_order[2][:-1])
        first = np.r_[True, ~same] if len(word) else np.zeros(0, bool)
        word, h, line = (x[first] for x in in_order)
        self.word, self.line, self.owner, self.number = word, line, owner, number
        self.n = n = np.bincount(line, minlength=len(owner))
        doc, tie = b.column(0).to_numpy(), b.column(1).to_numpy()
        self.doc = doc[owner] if len(owner) else doc[:0]
        self.pos = ((tie[owner] & 0x7FFFFFFF) << 32) | number if len(owner) else np.zeros(0, np.int64)
        self.set, self.odd, self.wide = np.zeros(len(owner), np.uint64), np.zeros(len(owner), np.uint64), np.zeros((len(owner), 4), np.uint64)
        if len(word):
            starts = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
            mixed = mix(h)
            self.set[line[starts]] = np.add.reduceat(mixed, starts)
            self.odd[line[starts]] = np.bitwise_xor.reduceat(np.uint64(1) << (mixed >> np.uint64(58)), starts)
            m = mixed >> np.uint64(16)
            bit = np.uint64(1) << (m & np.uint64(63))
            if not (n > _LONG).any():
                self.wide[line[starts], 0] = np.bitwise_xor.reduceat(bit, starts)
            else:
                limb = np.where((n > _LONG)[line], (m >> np.uint64(6)) & np.uint64(3), np.uint64(0))
                for k in range(4):
                    self.wide[line[starts], k] = np.bitwise_xor.reduceat(np.where(limb == k, bit, np.uint64(0)), starts)

    def postings(self, threshold: float) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """A posting for each prefix word, by columns, and the line of each. Lines of so few words that no set of another size can
        match, nor another of the same size, meet by their set."""
        n = self.n
        start = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=start[1:])
        i = np.arange(len(self.word)) - start[self.line]
        lone = n / (n + 1) < threshold - 1e-9
        prefix = np.where(lone, 1, n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1)
        own = i < prefix[self.line]
        at = self.line[own]
        p = {"word": np.where(lone[at], mix(self.set[at]), self.word[own]), "doc": self.doc[at], "pos": self.pos[at], "odd": self.odd[at]}
        p |= {"set": (self.set[at] >> np.uint64(32)).astype("<u4"), "n": n[at].astype("<u4"), "i": i[own].astype("<u4")}
        return p | {f"wide{k}": np.ascontiguousarray(self.wide[:, k])[at] for k in range(4)}, at


def _repeats(lines: list[_Lines], before: list[int], texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the lines of some slices of texts: those with the words of an earlier one, and those that are an earlier one,
    met again in a repeated row. Signatures only say which lines to compare."""
    doc, pos, n, sets = (np.concatenate([getattr(x, k) for x in lines]) for k in ("doc", "pos", "n", "set"))
    owner, number = np.concatenate([x.owner + b for x, b in zip(lines, before, strict=True)]), np.concatenate([x.number for x in lines])
    again, twin = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
    if not len(doc):
        return again, twin
    sign = mix(sets + n.astype(np.uint64)) >> np.uint64(64 - bits)
    order = np.lexsort((pos, doc, sign))
    same = sign[order][1:] == sign[order][:-1]
    head = np.maximum.accumulate(np.where(np.r_[True, ~same], np.arange(len(order)), 0))
    split: dict[int, list[str]] = {}

    def line(k: int) -> str:
        o = int(owner[k])
        if o not in split:
            split[o] = texts[o].as_py().lower().split("\n")
        return split[o][int(number[k])]

    for at in (np.flatnonzero(same) + 1).tolist():
        k, before_it, first = order[at], order[at - 1], order[head[at]]
        if doc[k] == doc[before_it] and pos[k] == pos[before_it]:
            twin[k], again[k] = True, again[before_it]
        else:
            again[k] = n[k] == n[first] and (line(k) == line(first) or _words(line(k)) == _words(line(first)))
    return again, twin


def _planes(p: dict[str, np.ndarray], order: np.ndarray) -> np.ndarray:
    """Columns of postings in some order as rows of bytes, each column's first bytes first: rows of bytes that hardly
    differ shrink to nothing."""
    return np.concatenate([p[k].take(order).astype(kind, copy=False).view(np.uint8).reshape(len(order), -1).T for k, kind in _POSTING.items()])


def _columns(packs: list[bytes], unpacker: zstandard.ZstdDecompressor) -> dict[str, np.ndarray]:
    """The columns of packed planes."""
    size = sum(np.dtype(kind).itemsize for kind in _POSTING.values())
    planes = [np.frombuffer(unpacker.decompress(x), np.uint8).reshape(size, -1) for x in packs]
    out, at = {}, 0
    for k, kind in _POSTING.items():
        n = np.dtype(kind).itemsize
        out[k] = np.ascontiguousarray(np.concatenate([x[at : at + n] for x in planes], axis=1).T).view(kind).reshape(-1)
        at += n
    return out


def postings(rows: DataFrame, counts: Broadcast, threshold: float, parts: int, only: Broadcast | None = None, bits: int = 64) -> DataFrame:
    """part, kind, packed: postings (kind 0) by word, and lines that repeat an earlier one of their block (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(1)
        for batch in batches:
            for block in slices(batch, _BLOCK):
                lines, before, at = [], [], 0
                for b in slices(block, _SORTED):
                    lines.append(_Lines(b, counts.value, None if only is None else only.value))
                    before.append(at)
                    at += b.num_rows
                again, twin = _repeats(lines, before, block.column(2), bits)
                found, done = [], 0
                for x in lines:
                    p, line = x.postings(threshold)
                    own = ~(again | twin)[done + line]
                    if only is not None:
                        own &= hits(only.value, p["word"].astype(np.int64))
                    own = np.flatnonzero(own)
                    found.append({k: v.take(own) for k, v in p.items()})
                    done += len(x.doc)
                p = {k: np.concatenate([x[k] for x in found]) for k in _POSTING}
                gone = np.empty(int((again & ~twin).sum()), _LINE)
                gone["doc"], gone["pos"] = (np.concatenate([getattr(x, k) for x in lines])[again & ~twin] for k in ("doc", "pos"))
                del lines, found
                to = (mix(p["word"]) % np.uint64(parts)).astype(np.int64)
                by = np.argsort(to.astype(np.uint16) if parts < 1 << 16 else to, kind="stable")
                to, planes = to[by], _planes(p, by)
                cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, np.int64)
                blocks = [packer.compress(np.ascontiguousarray(planes[:, a:b])) for a, b in zip(cuts, np.r_[cuts[1:], len(to)], strict=True)] if len(to) else []
                ids, kinds = [int(to[c]) for c in cuts], [0] * len(blocks)
                if len(gone) and only is None:
                    ids.append(int(gone["pos"][0] % parts)), kinds.append(1), blocks.append(packer.compress(np.ascontiguousarray(gone.view(np.uint8).reshape(len(gone), -1).T)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blocks, pa.binary())], names=["part", "kind", "packed"])

    return rows.select("doc", "tie", "text").mapInArrow(lean(run), "part int, kind int, packed binary")


def _alike(p: dict[str, np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted postings: which have the signature of an earlier one of their word, and the last such before each.
    Where it is the line's first posting `bits` of the signature count, elsewhere all that there is."""
    part = mix(p["odd"] + mix((p["set"].astype(np.uint64) << np.uint64(32)) + p["n"]))
    for k in range(4):
        part = mix(part + p[f"wide{k}"])
    if bits < 64:
        part = np.where(p["i"] == 0, part >> np.uint64(64 - bits), part)
    part += mix(p["word"])
    order = np.argsort(part)
    part = part[order]
    again = np.flatnonzero(part[1:] == part[:-1])
    group = np.zeros(len(part), bool)
    group[again] = group[again + 1] = True
    order[group] = order[group][np.lexsort((order[group], part[group]))]  # postings of one key in their order
    later, before = order[again + 1], order[again]
    same = p["word"][later] == p["word"][before]
    if bits == 64:
        for k in ("odd", "set", "n", *(f"wide{k}" for k in range(4))):
            same &= p[k][later] == p[k][before]
    hit, last = np.zeros(len(part), bool), np.zeros(len(part), np.int64)
    hit[later[same]], last[later[same]] = True, before[same]
    return hit, last


def _candidates(p: dict[str, np.ndarray], threshold: float, wanted: np.ndarray | None, listed: int, bits: int):
    """Of postings: pairs of a line and an earlier one of like signature (at the line's first posting); and places of
    candidate pairs, later and earlier, with a sign. Without `wanted`: the earliest candidates of each line and word, up
    to one that differs so little that it is hardly wrong, or to so many; and whether there are more. With it: all
    candidates of these lines."""
    order = np.lexsort((p["pos"], p["doc"], p["word"]))
    word, doc, pos = (p[k].take(order) for k in ("word", "doc", "pos"))
    twin = np.flatnonzero((word[1:] == word[:-1]) & (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1]))
    if len(twin):
        order = np.delete(order, twin + 1)  # a repeated row sends a line twice
    p = {k: v.take(order) for k, v in p.items()}
    same, last = _alike(p, bits) if bits and len(order) else (np.zeros(len(order), bool), np.zeros(len(order), np.int64))
    pairs, keep = np.flatnonzero(same & (p["i"] == 0)), np.flatnonzero(~same)
    equal = {k: np.stack([p[k][pairs], p[k][last[pairs]]], 1) for k in ("doc", "pos")}
    p = {k: v.take(keep) for k, v in p.items()}
    at, word, wide = np.arange(len(p["word"])), p["word"], [p[f"wide{k}"] for k in range(4)]
    start = np.maximum.accumulate(np.where(np.r_[True, word[1:] != word[:-1]], at, 0)) if len(at) else at
    n, odd = p["n"].astype(np.int64), p["odd"]
    rest = n - p["i"]
    need, differ, fold = threshold / (1 + threshold), (1 - threshold) / (1 + threshold), wide[0] ^ wide[1] ^ wide[2] ^ wide[3]
    loose = (differ * n + 1e-3).astype(np.float32)  # the sum of two bounds the words that differ, with some slack
    later = np.flatnonzero(start < at)
    if wanted is not None:
        later = later[hits(wanted, _line_ids(p["doc"][later], p["pos"][later]))]
    later = later[np.argsort(start[later] - later, kind="stable")]  # those with the most lines before them first
    found, c = [], 0
    count, sure, more, done = np.zeros(len(at), np.int64), np.zeros(len(at), bool), np.zeros(len(at), bool), np.zeros(len(at), bool)
    first, fewer, own_odd, own_loose = start[later], start[later] - later, odd[later], loose[later]
    while m := int(np.searchsorted(fewer, -c)):  # lines with more than c before them
        x = first[:m] + c
        near = np.flatnonzero(np.bitwise_count(own_odd[:m] ^ odd.take(x)) <= own_loose[:m] + loose.take(x))
        y, x = later[near], x[near]
        if wanted is None:
            open_ = ~done[y]
            y, x = y[open_], x[open_]
        own_n, other_n = n.take(y), n.take(x)
        both = own_n + other_n
        fits = np.flatnonzero((np.minimum(own_n, other_n) >= threshold * np.maximum(own_n, other_n) - 1e-9) & (np.minimum(rest.take(y), rest.take(x)) >= need * both - 1e-9))
        y, x, most = y[fits], x[fits], differ * both[fits] + 1e-9
        apart = np.maximum(np.bitwise_count(odd.take(y) ^ odd.take(x)), np.bitwise_count(fold.take(y) ^ fold.take(x))).astype(np.int64)
        long = np.flatnonzero((own_n[fits] > _LONG) & (other_n[fits] > _LONG))
        if len(long):
            apart[long] = np.maximum(apart[long], sum(np.bitwise_count(w[y[long]] ^ w[x[long]]).astype(np.int64) for w in wide))
        ok = apart <= most
        if wanted is None:
            full = ok & (sure[y] | (count[y] >= listed))
            more[y[full]] = done[y[full]] = True
            ok &= ~full
            count[y[ok]] += 1
            sure[y[ok & (apart <= SURE * most)]] = True
        found.append((y[ok], x[ok]))
        c += 1
        if c % 16 == 0 and wanted is None:
            left = ~done[later]
            later, first, fewer, own_odd, own_loose = later[left], first[left], fewer[left], own_odd[left], own_loose[left]
    y = np.concatenate([a for a, _ in found]) if found else np.zeros(0, np.int64)
    x = np.concatenate([b for _, b in found]) if found else np.zeros(0, np.int64)
    return p, equal, y, x, more[y]


_MEET = "kind int, doc long, pos long, other_doc long, other_pos long, word long, more boolean"


def meet(dealt: DataFrame, threshold: float, wanted: Broadcast | None = None, listed: int = LISTED, bits: int = 64) -> DataFrame:
    """kind 1: a line that repeats an earlier one; 2: a candidate pair (line, earlier line), the word they met at, and
    whether the line has more candidates for it; 3: a line and an earlier one of like signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs: dict[int, list[bytes]] = {}
        unpacker = zstandard.ZstdDecompressor()

        def out(kind: int, doc: np.ndarray, pos: np.ndarray, other: tuple[np.ndarray, np.ndarray] | None = None, word: np.ndarray | None = None, more: np.ndarray | None = None) -> pa.RecordBatch:
            none, n = pa.nulls(len(doc), pa.int64()), len(doc)
            ends = [none, none] if other is None else [pa.array(x) for x in other]
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(doc), pa.array(pos), *ends, none if word is None else pa.array(word.astype(np.int64)), pa.array(np.zeros(n, bool) if more is None else more)], names=["kind", "doc", "pos", "other_doc", "other_pos", "word", "more"])

        for b in batches:
            for part, kind, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == 1:
                    gone = np.ascontiguousarray(np.frombuffer(unpacker.decompress(packed), np.uint8).reshape(_LINE.itemsize, -1).T).view(_LINE).reshape(-1)
                    yield out(1, gone["doc"], gone["pos"])
                else:
                    packs.setdefault(part, []).append(packed)
        for part in list(packs):
            p, equal, y, x, more = _candidates(_columns(packs.pop(part), unpacker), threshold, None if wanted is None else wanted.value, listed, bits)
            doc, pos = equal["doc"], equal["pos"]
            if len(doc) and wanted is None:
                yield out(3, doc[:, 0], pos[:, 0], (doc[:, 1], pos[:, 1]))
            for a in range(0, len(y), 100_000):
                u, v = y[a : a + 100_000], x[a : a + 100_000]
                yield out(2, p["doc"][u], p["pos"][u], (p["doc"][v], p["pos"][v]), p["word"][u], more[a : a + 100_000])

    return dealt.mapInArrow(lean(run), _MEET)


def _line_texts(rows: DataFrame, bits: Broadcast, repeated: bool) -> DataFrame:
    """doc, pos, line of at least the lines of a bitmap; a later join is exact. A line once, whatever rows repeat it
    (where ids are `repeated`, rows may)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, _BLOCK):
                docs, ties, split = b.column(0).to_numpy(), b.column(1).to_numpy(), [(t.as_py() or "").split("\n") for t in b.column(2)]
                n = np.array([len(x) for x in split], np.int64)
                doc, tie = np.repeat(docs, n), np.repeat(ties, n)
                number = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                pos = ((tie & 0x7FFFFFFF) << 32) | number
                at = np.flatnonzero(hits(bits.value, _line_ids(doc, pos)))
                flat = [x for t in split for x in t]
                yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(pos[at]), pa.array([flat[k] for k in at], pa.string())], names=["doc", "pos", "line"])

    texts = materialize(rows.select("doc", "tie", "text").mapInArrow(lean(run), "doc long, pos long, line string"), "line-texts")
    if repeated and texts.groupBy("doc", "pos").count().filter("count > 1").limit(1).count():
        twice, texts = texts, materialize(texts.dropDuplicates(["doc", "pos"]), "line-texts")
        discard(twice)
    return texts


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """kind, doc, pos, more, ok of pairs: whether the line matches the other, on their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for s, t in zip(b.column(4), b.column(5), strict=True):
                s, t = s.as_py().lower(), t.as_py().lower()
                if s == t:
                    ok.append(True)
                    continue
                x, y = _words(s), _words(t)
                both = len(x & y)
                ok.append(both >= threshold * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(ok, pa.bool_())], names=["kind", "doc", "pos", "more", "ok"])

    one = texts.select(F.col("doc").alias("d"), F.col("pos").alias("p"), "line")
    with_own = pairs.join(one, (F.col("doc") == F.col("d")) & (F.col("pos") == F.col("p"))).select("kind", "doc", "pos", "more", "other_doc", "other_pos", F.col("line").alias("own"))
    both = with_own.join(one, (F.col("other_doc") == F.col("d")) & (F.col("other_pos") == F.col("p"))).select("kind", "doc", "pos", "more", "own", F.col("line").alias("other"))
    return materialize(both.mapInArrow(lean(run), "kind int, doc long, pos long, more boolean, ok boolean"), "line-verified")


def _few_matches(rows: DataFrame, asked: list[tuple[int, int, str]], counts: np.ndarray, threshold: float) -> DataFrame:
    """doc, pos of those of a few lines that match an earlier line. A match has at least t n of a line's n words, so it
    has one of any n - ceil(t n) + 1 of them; the rarest are looked for in all texts."""
    by_word: dict[int, list[int]] = {}
    for k, (_, _, line) in enumerate(asked):
        h = np.unique(_hashed(pa.array([line]))[0])
        rare = h[np.argsort(counts[(h & np.uint64(CELLS - 1)).astype(np.int64)], kind="stable")]
        for x in rare[: len(h) - int(np.ceil(threshold * len(h) - 1e-9)) + 1].tolist():
            by_word.setdefault(x, []).append(k)
    seen = np.zeros(1 << 20, bool)
    seen[[x & 0xFFFFF for x in by_word]] = True
    shared = rows.sparkSession.sparkContext.broadcast(([(d, p, _words(t)) for d, p, t in asked], by_word, seen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, words, flags = shared.value
        for batch in batches:
            hit: set[int] = set()
            for b in slices(batch, _SORTED):
                cut = _Cut(b.column(2))
                h = cut.hashes
                found = [at for at in np.flatnonzero(flags[(h & np.uint64(0xFFFFF)).astype(np.int64)]).tolist() if int(h[at]) in words]
                if not found:
                    continue
                line, owner, number = cut.lines()
                docs, ties = b.column(0).to_numpy(), b.column(1).to_numpy()
                split: dict[int, list[str]] = {}
                for at in found:
                    for k in words[int(h[at])]:
                        o, j = int(owner[line[at]]), int(number[line[at]])
                        doc, pos, mine = lines[k]
                        if k in hit or (int(docs[o]), (int(ties[o]) & 0x7FFFFFFF) << 32 | j) >= (doc, pos):
                            continue
                        if o not in split:
                            split[o] = b.column(2)[o].as_py().split("\n")
                        other = _words(split[o][j])
                        both = len(mine & other)
                        if both >= threshold * (len(mine) + len(other) - both) - 1e-9:
                            hit.add(k)
            yield pa.RecordBatch.from_arrays([pa.array([lines[k][0] for k in hit], pa.int64()), pa.array([lines[k][1] for k in hit], pa.int64())], names=["doc", "pos"])

    return rows.select("doc", "tie", "text").mapInArrow(lean(run), "doc long, pos long").distinct()


def removed_lines(rows: DataFrame, threshold: float = 0.8, listed: int = LISTED, few_lines: int = FEW_LINES, bits: int = 64) -> DataFrame:
    """doc, pos of each line to remove, from rows (doc, tie, text). `bits` of a set's hash are its signature; with 0
    there are none."""
    spark = rows.sparkSession
    parts = 4 * width(spark)
    counts = word_counts(rows)
    repeated = rows.groupBy("doc").count().filter("count > 1").limit(1).count() > 0
    scratch: list[DataFrame] = []

    def keep(df: DataFrame, name: str = "") -> DataFrame:
        scratch.append(materialize(df, name) if name else df)
        release(spark)
        return scratch[-1]

    deal = lambda p: p.repartition(width(spark), "part").select("part", "kind", "packed")
    line, other = ["doc", "pos"], ["other_doc", "other_pos"]
    met = keep(meet(deal(postings(rows, counts, threshold, parts, None, bits or 64)), threshold, None, listed, bits), "line-candidates")
    near = met.filter("kind = 2")
    # some candidate of each line: both values are of one row, the first that comes
    first = keep(near.groupBy(*line).agg(*[F.any_value(c).alias(c) for c in other], F.bool_or("more").alias("more")), "line-first")
    wanted = met.filter("kind > 1")
    ends = bitmap(wanted.select(*line).union(wanted.select(*other)), _batch_ids)
    texts = keep(_line_texts(rows, ends, repeated))
    ends.destroy()
    asked = first.select(F.lit(2).alias("kind"), *line, *other, "more").union(met.filter("kind = 3").select("kind", *line, *other, F.lit(False).alias("more")))
    one = keep(_verified(asked, texts, threshold))
    if one.filter("kind = 3 and not ok").limit(1).count():  # like signatures, other words: do without them
        counts.destroy()
        for x in scratch:
            discard(x)
        return removed_lines(rows, threshold, listed, few_lines, 0)
    out = [met.filter("kind = 1").select(*line), one.filter("ok").select(*line)]
    failed = one.filter("kind = 2 and not ok").select(*line, "more")
    if failed.limit(1).count():
        others = near.select(*line, *other).distinct().join(failed, line).join(first.select(*line, *other), [*line, *other], "left_anti")
        two = keep(_verified(others.select(F.lit(2).alias("kind"), *line, "more", *other), texts, threshold))
        out.append(two.filter("ok").select(*line).distinct())
        left = keep(failed.filter("more").select(*line).join(out[-1], line, "left_anti"), "lines-left")
        open_ = left.count()
        few = left.join(texts, line) if 0 < open_ <= few_lines else None
        if few is not None and few.agg(F.sum(F.octet_length("line"))).first()[0] <= FEW_BYTES:
            held = [(r["doc"], r["pos"], r["line"]) for r in few.collect()]
            out.append(keep(_few_matches(rows, held, counts.value, threshold), "line-matches"))
        elif open_:
            out.append(keep(_all_matches(rows, met, left, counts, threshold, parts, deal)))
    found = out[0]
    for x in out[1:]:
        found = found.union(x)
    found = materialize(found, "lines-gone")
    counts.destroy()
    for x in scratch:
        discard(x)
    release(spark)
    return found


def _all_matches(rows: DataFrame, met: DataFrame, left: DataFrame, counts: Broadcast, threshold: float, parts: int, deal) -> DataFrame:
    """doc, pos of those of many lines that match an earlier line: all their candidates are fetched and verified."""
    line, other = ["doc", "pos"], ["other_doc", "other_pos"]
    lines = bitmap(left, _batch_ids)

    def words(b: pa.RecordBatch) -> np.ndarray:
        return b.column(2).to_numpy()[hits(lines.value, _batch_ids(b))]

    near = met.filter("kind = 2")
    only = bitmap(near.select(*line, "word"), words)
    again = meet(deal(postings(rows, counts, threshold, parts, only)), threshold, lines).filter("kind = 2").select(*line, *other).distinct()
    pairs = materialize(again.join(left, line, "left_semi").join(near.select(*line, *other), [*line, *other], "left_anti"), "line-pairs")
    ends = bitmap(pairs.select(*line).union(pairs.select(*other)), _batch_ids)
    texts = _line_texts(rows, ends, True)
    verified = _verified(pairs.select(F.lit(2).alias("kind"), *line, F.lit(False).alias("more"), *other), texts, threshold)
    out = materialize(verified.filter("ok").select(*line).distinct(), "line-matches")
    for x in (pairs, texts, verified):
        discard(x)
    for x in (lines, only, ends):
        x.destroy()
    return out


def dedup(docs: DataFrame, threshold: float = 0.8, listed: int = LISTED, few_lines: int = FEW_LINES, bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of the input, the text without its removed lines, and n_lines, n_removed."""
    text = F.col(text_col).cast("string")
    key, tie = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)), F.xxhash64(text).bitwiseAND(0x7FFFFFFF)
    gone = removed_lines(docs.select(key.alias("doc"), tie.alias("tie"), text.alias("text")), threshold, listed, few_lines, bits)
    gone = gone.groupBy(F.col("doc").alias("__doc"), F.shiftright("pos", 32).alias("__tie")).agg(F.collect_set((F.col("pos").bitwiseAND(0xFFFFFFFF)).cast("int")).alias("__gone"))
    whole = docs.withColumns({"__d": key, "__t": tie}).join(gone, (F.col("__d") == F.col("__doc")) & (F.col("__t") == F.col("__tie")), "left")
    lines = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))  # in order, by hashing
    kept = F.array_join(F.transform(kept, lambda i: F.get(F.col("__lines"), i)), "\n")
    whole = whole.withColumn("__lines", F.when(F.col("__gone").isNotNull(), lines))
    n = F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    out = whole.withColumns({"__n": n, "__removed": F.coalesce(F.size("__gone"), F.lit(0)).cast("long"), "__text": F.when(F.col("__gone").isNull(), text).otherwise(kept)})
    return out.select(*[F.col("__text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")], F.col("__n").alias("n_lines"), F.col("__removed").alias("n_removed"))


#: The same rows by a prefix filter alone. Ids are taken to be distinct.
ORACLE_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL),
t AS MATERIALIZED (SELECT doc_id, k, list_filter(list_distinct(string_split_regex(lower(line), '[\\x00-\\x20]+')), lambda x: x <> '') AS w FROM l),
o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id, k) AS ln, doc_id, k, w, len(w) AS n FROM t WHERE len(w) >= 1),
u AS (SELECT ln, n, unnest(w) AS x FROM o),
f AS (SELECT x, count(*) AS df FROM u GROUP BY x),
p AS MATERIALIZED (SELECT ln, n, x FROM (SELECT ln, n, x, row_number() OVER (PARTITION BY ln ORDER BY df, x) AS r FROM u JOIN f USING (x)) WHERE r <= n - ceil(0.8 * n - 1e-9) + 1),
c AS (SELECT DISTINCT a.ln AS later, b.ln AS earlier FROM p a JOIN p b ON a.x = b.x AND b.ln < a.ln AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9),
h AS (SELECT DISTINCT later FROM (SELECT later, len(list_intersect(a.w, b.w)) AS m, a.n + b.n AS n FROM c JOIN o a ON a.ln = later JOIN o b ON b.ln = earlier) WHERE m >= 0.8 * (n - m) - 1e-9),
g AS (SELECT doc_id, k FROM o JOIN h ON ln = later),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY k) AS text, count(*) AS n FROM l ANTI JOIN g USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE len(string_split(d.text, chr(10))) END::BIGINT AS n_lines, (SELECT count(*) FROM g WHERE g.doc_id = d.doc_id)::BIGINT AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text FROM documents d LEFT JOIN kept USING (doc_id)
"""
