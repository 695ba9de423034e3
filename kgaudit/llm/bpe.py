"""Byte-level BPE: an exact backtracking encoder and an offset-table decoder.

A text is cut at added tokens and then into pieces by the vocabulary's pattern. For a piece an Aho-Corasick automaton
gives the longest token that starts at each place. The encoder lays tokens from left to right, each time the longest
that is compatible with the token before it, and steps back where none is. Two tokens are compatible when merging
their bytes by rank would keep the border between them; the verdicts are kept in a table of pairs. A place that was
stepped back from is never tried again, so the work is linear in the length of the piece, and the result equals that
of applying all merges by rank.

The decoder gathers bytes from one blob by a table of offsets.

Defined cases: null and empty texts encode to no tokens and decode to the empty text. Rows are independent, so
repeated rows and null ids pass through; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from kgaudit.llm.memory import Recent, lean

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: What a task keeps, in entries: encodings of pieces (of at most LONGEST_KEPT signs) and verdicts on pairs of tokens.
#: Bounds memory and changes no result.
KEPT_PIECES, LONGEST_KEPT, KEPT_PAIRS = 150_000, 64, 200_000
_SPACE = r"\t-\r \x85\xa0  -     　"
_PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_ASCII = r"\t-\r "
_ASCII_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^{_ASCII}A-Za-z0-9]+|[{_ASCII}]+(?![^{_ASCII}])|[{_ASCII}]+")


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte in a byte-level vocabulary: printable Latin-1 signs for
    themselves, the others for code points from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Bpe:
    """A vocabulary file of byte-level BPE (tokens, merges by rank, added tokens)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        signs = byte_signs()
        self.signs = signs
        # ranks: single bytes first, then one for each merge
        names = list(signs)
        rank = {s: i for i, s in enumerate(names)}
        self.pairs: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(256)]
        for merge in spec["model"]["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            new = a + b
            if new not in rank:
                rank[new] = len(names)
                names.append(new)
                self.halves.append((rank[a], rank[b]))
            self.pairs.setdefault((rank[a], rank[b]), rank[new])
        self.rank, self.names = rank, names
        self.ids = np.array([vocab[n] for n in names], "<u4")
        self.sizes = [len(n) for n in names]
        self.shorter: dict[int, int] = {}
        self.fits: dict[int, bool] = {}
        self.matcher = ahocorasick.Automaton()
        for n, r in rank.items():
            self.matcher.add_word(n, r)
        self.matcher.make_automaton()
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.at_added = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.known = Recent(self._ids_of, KEPT_PIECES)
        # decoding: bytes of id i are blob[offsets[i]:offsets[i + 1]]
        back = {s: b for b, s in enumerate(signs)}
        by_id = {i: bytes(back[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.added.items()}
        lengths = np.zeros(max(by_id) + 2, np.int64)
        for i, b in by_id.items():
            lengths[i + 1] = len(b)
        self.offsets = np.cumsum(lengths)
        self.blob = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(max(by_id) + 1)), np.uint8)

    def _prefix(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        if (p := self.shorter.get(token)) is None:
            name = self.names[token]
            p = next((r for k in range(len(name) - 1, 0, -1) if (r := self.rank.get(name[:k])) is not None), -1)
            self.shorter[token] = p
        return p

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank keeps the border between the two tokens."""
        key = left * len(self.names) + right
        if (known := self.fits.get(key)) is None:
            if len(self.fits) >= KEPT_PAIRS:
                self.fits.clear()
            known = self.fits[key] = self._keeps_border(left, right)
        return known

    def _keeps_border(self, a: int, b: int) -> bool:
        """Unmerges the younger of the two tokens at the border, again and again. A merge across the border that is
        older than what was unmerged would have come first and taken the border away."""
        limit = len(self.names)
        while True:
            if (m := self.pairs.get((a, b))) is not None and m < limit:
                return False
            if a >= 256 and (a > b or b < 256):
                limit, a = a, self.halves[a][1]
            elif b >= 256:
                limit, b = b + 1, self.halves[b][0]  # of equal merges the left comes first
            else:
                return True

    def encode_signs(self, piece: str) -> list[int]:
        """Ranks of the tokens of a piece that is written in byte signs."""
        n = len(piece)
        if (whole := self.rank.get(piece)) is not None:
            return [whole]  # the longest match at the start, with nothing before it
        longest = [0] * n
        size = self.sizes
        for end, r in self.matcher.iter(piece):
            start = end - size[r] + 1
            if size[r] > size[longest[start]] or longest[start] < 256:
                longest[start] = r
        open_at = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + size[token]
                if open_at[end] and (last < 0 or self.compatible(last, token)):
                    break
                token = self._prefix(token)
            if token >= 0:
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
            else:
                open_at[at] = 0
                token = out.pop()
                at -= size[token]

    def _ids_of(self, piece: str) -> bytes:
        signs = self.signs
        return self.ids[self.encode_signs("".join([signs[b] for b in piece.encode()]))].tobytes()

    def encode(self, text: str) -> np.ndarray:
        parts = self.at_added.split(text) if self.at_added and any(t in text for t in self.added) else (text,)
        out: list[bytes] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(np.uint32(self.added[part]).astype("<u4").tobytes())
                continue
            known, new = self.known, self._ids_of
            out += [known[p] if len(p) <= LONGEST_KEPT else new(p) for p in (_ASCII_PIECE if part.isascii() else _PIECE).findall(part)]
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        starts, ends = self.offsets[ids], self.offsets[ids.astype(np.int64) + 1]
        sizes = ends - starts
        before = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)
        return self.blob[at].tobytes().decode("utf-8", errors="replace")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded: the operator's own output."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(path)  # in each task: it takes a fraction of a second, and nothing stays in the worker
        for batch in batches:
            ids = [bpe.encode(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())), pa.array([bpe.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(lean(run), "doc_id long, ids array<long>, decoded string")


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and digests of the ids (unsigned 32-bit, little-endian) and of the text decoded from them."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(path)  # in each task: it takes a fraction of a second, and nothing stays in the worker
        for batch in batches:
            n, a, b = [], [], []
            for t in batch.column(1):
                ids = bpe.encode(t.as_py() or "")
                n.append(len(ids))
                a.append(hashlib.sha256(ids.tobytes()).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(lean(run), SCHEMA)
