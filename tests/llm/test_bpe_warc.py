import gzip
import hashlib
import random
import zlib

import pyarrow.fs as pafs
import pytest

from kgaudit.llm import bpe, warc

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def both():
    path = bpe.default_path()
    return bpe.Bpe(path), tokenizers.Tokenizer.from_file(path)


def test_encoding_is_that_of_the_library(both):
    own, lib = both
    rng = random.Random(3)
    signs = "abcdefgthe  \t\n\r\x1c\x1f\x85\xa0'stévllrmd019,.!?-_漢字é́😀   　①½"
    for k in range(6000):
        t = "".join(rng.choices(signs if k % 2 else "abcdetrsino", k=rng.randint(0, 50)))
        t += "<|endoftext|>" * (k % 17 == 0)
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t).tolist() == ids, t
        assert own.decode(own.encode(t)) == lib.decode(ids, skip_special_tokens=False)


def test_long_pieces(both):
    own, lib = both
    for t in ("a" * 50_000, "ab" * 30_000, " " * 20_000, "é" * 10_000):
        assert own.encode(t).tolist() == lib.encode(t, add_special_tokens=False).ids


def test_bytes_that_are_no_text_decode_to_marks(both):
    own, lib = both
    ids = lib.encode("é", add_special_tokens=False).ids
    assert own.decode(bpe.np.array(ids[:1], "<u4")) == lib.decode(ids[:1], skip_special_tokens=False)


def test_kept_pieces_are_bounded(both, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 3)
    own = bpe.Bpe(bpe.default_path())
    t = " ".join(f"word{i}xq" for i in range(50))
    assert own.encode(t).tolist() == both[1].encode(t, add_special_tokens=False).ids and len(own.known) <= 3


def test_round_trip_rows(spark, both):
    rows = spark.createDataFrame([(1, "Hello é", "z"), (1, "Hello é", "z"), (None, None, "z"), (2, "", "z")], "doc_id long, text string, n_tokens string")
    got = {(r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in bpe.round_trip(rows).collect()}
    n = len(both[1].encode("Hello é", add_special_tokens=False).ids)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {(1, n, sha("Hello é")), (None, 0, sha("")), (2, 0, sha(""))}
    assert bpe.round_trip(rows.limit(0)).count() == 0
    assert {r["decoded"] for r in bpe.tokens(rows).collect()} == {"Hello é", ""}


def pages(spark):
    rng = random.Random(5)
    rows = [(i, f"http://x/{i}", "".join(rng.choices("abc <>é\n", k=rng.randint(0, 4000)))) for i in range(60)]
    rows += [(100, "u", "same" * 40), (101, "u", "same" * 40), (99, None, "same" * 40), (99, None, "same" * 40), (None, "u", "same" * 40), (200, "u", "tiny"), (201, "u", "tiny"), (300, "u", None), (301, "u\r\nv", "")]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")


def want(rows):
    first = {}
    for r in rows:
        if len((r["html"] or "").encode()) >= 100 and r["page_id"] is not None:
            first[r["html"]] = min(first.get(r["html"], r["page_id"]), r["page_id"])
    out = []
    for r in rows:
        p = (r["html"] or "").encode()
        to = first.get(r["html"]) if len(p) >= 100 else None
        again = to is not None and (r["page_id"] is None or r["page_id"] > to)
        out.append((r["page_id"], len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("range_bytes", [7, 1000, 1 << 20])
def test_ranges_of_any_size_give_each_record_once(spark, range_bytes):
    df = pages(spark).repartition(3)
    got = warc.read(spark, warc.write(df), range_bytes)
    rows = got.collect()
    cols = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[c] for c in cols) for r in rows), key=str) == want(df.collect())
    texts = {r["page_id"]: bytes(r["payload"]) for r in rows if r["record_type"] == "response"}
    assert texts[301] == b"" and texts[5] == next(r["html"] for r in df.collect() if r["page_id"] == 5).encode()


def test_archives_are_gzip_files(spark, tmp_path):
    path = warc.write(pages(spark).coalesce(1), str(tmp_path / "w"))
    part = next((tmp_path / "w").glob("part-*"))
    raw = gzip.decompress(part.read_bytes())
    assert raw.startswith(b"WARC/1.1") and raw.count(b"WARC-Type: response") == 66 and path


def test_no_record_hides_in_another(tmp_path):
    inner = warc._gzip(warc._record(1, "u", b"inside", hashlib.sha256(b"inside").hexdigest(), None))
    noise = random.Random(1).randbytes(3000) + warc.MAGIC + random.Random(2).randbytes(3000)
    outer = warc._gzip(warc._record(2, "u", noise + inner + noise, hashlib.sha256(noise + inner + noise).hexdigest(), None))
    (tmp_path / "f").write_bytes(outer + inner)
    with pafs.LocalFileSystem().open_input_file(str(tmp_path / "f")) as f:
        for step in (64, 1 << 20):
            for cut in (1, len(outer) // 2, len(outer), len(outer) + 1):
                at = [a for s, e in ((0, cut), (cut, f.size())) for a, _ in warc.scan_range(f, s, e, step)]
                assert at == [0, len(outer)]


def test_large_member_ends_with_a_zero(monkeypatch):
    raw = b"x" * (17 << 20)
    member = warc._gzip(raw)
    assert member[-1] == 0 and gzip.decompress(member) == raw and zlib.decompressobj(31).decompress(member) == raw


def test_no_pages(spark):
    df = pages(spark).limit(0)
    assert warc.archive_round_trip(df).count() == 0
