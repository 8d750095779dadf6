"""WARC, token store, pieces and nearest neighbours: exact round trips, brute force, recall."""

import base64
import gzip
import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillet.llm import hnsw, piece_sampling, token_store, warc, words
from rillet.llm.common import new_path

from .data import SCHEMA, documents, frame

tokenizers = pytest.importorskip("public_tokenizers")


def pages():
    rows = [(i, f"http://h{i % 3}.example/{i}?q= a", f"<p>{i % 11}</p>" * (i % 5), "x", "y") for i in range(120)]
    rows += [(7, "http://other/", rows[7][2], None, None), (None, None, "<p>3</p>", None, None), (500, None, None, None, None), (501, "u", "", None, None), (502, "u", "ü" * 300_000, None, None), (499, "u", "\r\n\r\nWARC/1.1\r\n\r\n", None, None)]
    return rows


PAGES = "page_id long, url string, html string, digest string, shard string"


def test_warc_round_trip(spark):
    rows = spark.createDataFrame(pages(), PAGES).repartition(3)
    first = {}
    for r in pages():
        b = (r[2] or "").encode()
        first[b] = min(first.get(b, 10**9), 10**9 if r[0] is None else r[0])
    want = []
    for r in pages():
        b = (r[2] or "").encode()
        again = first[b] < (10**9 if r[0] is None else r[0])
        want.append((r[0], len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[b] if again else None))
    assert sorted(map(tuple, warc.round_trip(rows).collect()), key=str) == sorted(want, key=str)
    assert warc.round_trip(rows.limit(0)).count() == 0


def test_warc_files_are_deterministic_roll_and_are_listed(spark):
    rows = spark.createDataFrame(pages(), PAGES)
    lists = []
    for n in (2, 9):
        uri = new_path(spark, "warc-test")
        manifest = warc.write(warc.records(rows.repartition(n), revisit_from=10), uri, shard_bytes=2000, roll_bytes=3000).collect()
        lists.append(sorted(map(tuple, manifest)))
        folder = Path(uri.removeprefix("file://"))
        assert {p.name for p in folder.glob("*.gz")} == {m["file"] for m in manifest} and not list(folder.glob(".*.tmp"))
        assert sum(m["records"] for m in manifest) == len(pages())
        assert len({m["file"].split("-")[1] for m in manifest}) > 3
        text = gzip.decompress((folder / sorted(m["file"] for m in manifest)[0]).read_bytes())
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: ")
        small = warc.read(spark, uri).where("payload_bytes < 10 and record_type = 'revisit'")
        assert small.count() == 0
    assert lists[0] == lists[1]
    broken = folder / lists[1][0][0]
    broken.write_bytes(broken.read_bytes()[:-40])
    with pytest.raises(Exception):
        warc.read(spark, uri).collect()


def test_warc_deals_hot_identifiers_among_shards(spark):
    rows = spark.range(900).select(F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit(5)).otherwise(F.col("id")).cast("long").alias("page_id"), F.lit("http://h/a b").alias("url"), F.concat(F.lit("page "), F.col("id")).alias("html"))
    uri = new_path(spark, "warc-test")
    manifest = warc.write(warc.records(rows), uri, shard_bytes=800, roll_bytes=1 << 20).collect()
    assert sum(m["records"] for m in manifest) == 900 and max(m["records"] for m in manifest) < 400 and len(manifest) > 6
    folder = Path(uri.removeprefix("file://"))
    seen = [x for m in sorted(m["file"] for m in manifest) for x in gzip.decompress((folder / m).read_bytes()).decode().split("\r\n") if x.startswith("WARC-Record-ID")]
    number = lambda x: 2**63 if "null" in x else int(x.rsplit(":", 1)[1][:-1])
    assert [number(x) for x in seen] == sorted(number(x) for x in seen)
    got = warc.read(spark, uri)
    assert got.count() == 900 and {r["url"] for r in got.select("url").distinct().collect()} == {"http://h/a%20b"}


def test_token_store(spark):
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    odd = ["a  b\n c\t d ", "don't  'll <|endoftext|> x", "<|endoftext|>", "\u3000 a  b", " lead", "trail ", "\n", "   ", "\u1c89 no category in older tables"]
    assert 50256 in t.encode(odd[1], add_special_tokens=False).ids
    rows = [*documents(), *[(200 + i, x, *[None] * 10) for i, x in enumerate(odd)]]
    got = token_store.round_trip(frame(spark, rows), path).collect()
    assert len(got) == len(rows)
    ids = {}
    for r in rows:
        ids.setdefault(r[0], []).append(np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4"))
    for r in got:
        assert any(r["n_tokens"] == len(x) and r["ids_crc32"] == zlib.crc32(x.tobytes()) for x in ids[r["doc_id"]])
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    known = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"]) if r["doc_id"] is not None]
    assert known == sorted(known) and sorted(got, key=lambda r: r["start"])[-1]["doc_id"] is None
    assert token_store.round_trip(frame(spark, rows).limit(0), path).count() == 0


def test_chunks_are_stored_once_and_faults_are_found(spark):
    path = tokenizers.path("byte_bpe_50k.json")
    rows = [(i, "same words again " * 2000 + ("end" if i else ""), *[None] * 10) for i in range(6)]
    uri = new_path(spark, "store-test")
    token_store.write(frame(spark, rows), uri, path)
    chunks = spark.read.parquet(f"{uri}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count() < spark.read.parquet(f"{uri}/recipes").select(F.explode("digests")).count()
    assert token_store.read(spark, uri, path).count() == 6
    manifest = spark.read.parquet(f"{uri}/manifest").collect()
    assert sum(m["n_docs"] for m in manifest) == 6
    changed = spark.createDataFrame([(m["part"], m["n_docs"], m["n_tokens"], b"x" * 32) for m in manifest], token_store.MANIFEST)
    changed.write.mode("overwrite").parquet(f"{uri}/manifest")
    with pytest.raises(ValueError):
        token_store.read(spark, uri, path)


def test_pieces_are_those_of_the_tokenizer(monkeypatch):
    """Random texts, as a whole, with forgetting, and with hashes that collide, against the plain tokenizer."""
    path = tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(3)
    pool = [*"ab'strevldm'' \n\t 12.,!é中ß \x85\x1c\u200b\u0663²😄", "'s", "'re", "<|endoftext|>", "\u1c89", "'ll", "don't ", "  "]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(3000)]
    plain = token_store.Encoder(path)
    want = [plain.plain(t).tolist() for t in texts]

    def check():
        enc = token_store.Encoder(path)
        for at in range(0, len(texts), 500):
            ids, offsets = enc.encode(texts[at : at + 500])
            assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want[at : at + 500]

    check()
    monkeypatch.setattr(token_store, "REMEMBERED", 700)
    check()
    monkeypatch.setattr(words, "mix", lambda x: x % np.uint64(61))
    check()


def chunk_ends(ids, gears):
    return token_store.chunk_ends(token_store.rolling(ids, gears).tolist(), len(ids))


def test_chunk_ends():
    gears = token_store._gears()
    rng = np.random.default_rng(1)
    x = rng.integers(0, 50000, 40000).astype(np.uint16)
    ends = chunk_ends(x, gears)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(x) and sizes.max() <= token_store.MOST and sizes[:-1].min() >= token_store.LEAST
    y = np.concatenate([x[:100], x])  # the same stream later on is cut at the same places again
    assert len(set((np.array(chunk_ends(y, gears)) - 100).tolist()) & set(ends)) > len(ends) // 2
    assert chunk_ends(x[:0], gears) == [] and chunk_ends(x[:5], gears) == [5]
    assert chunk_ends(np.zeros(50000, np.uint16), gears)[-1] == 50000


def test_pieces_round_trip_and_repeat(spark):
    path = tokenizers.path("piece_bpe_32k.model")
    docs = frame(spark)
    got = piece_sampling.report(docs, path)
    assert got.where("not lossless").count() == 0 and got.count() == docs.count()
    key = lambda d: sorted((str(r[0]), r[1], r[2]) for r in d.collect())
    assert key(got) == key(piece_sampling.report(docs.repartition(2), path))
    assert key(got) != key(piece_sampling.report(docs, path, seed=1))
    encoded = piece_sampling.encode(docs, path)
    assert encoded.columns == [*docs.columns, "n_pieces", "pieces"]
    for r in piece_sampling.decode(encoded, path).collect():
        assert r["decoded"] == (r["text"] or "")
    assert piece_sampling.encode(spark.createDataFrame([], SCHEMA), path).count() == 0


def test_sampling_follows_the_lattice():
    """Frequencies of a short word's segmentations against all paths weighed one by one."""
    m = piece_sampling.PieceModel(tokenizers.path("piece_bpe_32k.model"), 0.2)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))
    weight = {sp.id_to_piece(i): np.exp(0.2 * -np.log(1 - sp.get_score(i))) for i in range(259, sp.get_piece_size())}

    def paths(s):
        if not s:
            yield (), 1.0
        for n in range(1, len(s) + 1):
            if s[:n] in weight:
                for rest, w in paths(s[n:]):
                    yield (s[:n], *rest), w * weight[s[:n]]

    every = dict(paths("▁then"))
    n = 20000
    drawn = {}
    flat, offsets = m.sample(["then"] * n, np.arange(n).astype(np.uint64))
    for ids in np.split(flat, offsets[1:-1]):
        k = tuple(sp.id_to_piece(int(i)) for i in ids)
        drawn[k] = drawn.get(k, 0) + 1
    assert set(drawn) <= set(every)
    for k, w in every.items():
        p = w / sum(every.values())
        assert abs(drawn.get(k, 0) / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-3


def test_draws_do_not_depend_on_what_was_met_before(monkeypatch):
    path = tokenizers.path("piece_bpe_32k.model")
    texts = [r[1] or "" for r in documents()]
    keys = np.arange(len(texts)).astype(np.uint64)
    m = piece_sampling.PieceModel(path)
    ids, offsets = m.sample(texts, keys)
    whole = [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
    monkeypatch.setattr(piece_sampling, "REMEMBERED", 300)
    m.clear()
    for i in reversed(range(len(texts))):
        ids, offsets = m.sample(["other words " * (i % 3), texts[i]], np.array([7, i], np.uint64))
        assert ids[offsets[1] :].tolist() == whole[i]
        assert m.decode(ids[offsets[1] :]).decode()[1:] == texts[i]


def vectors(n=3000, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dim))
    x = (centres[rng.integers(0, 40, n)] + rng.normal(size=(n, dim)) * 0.5).astype(np.float32)
    x[100:400] = x[100]  # a large group of equal vectors
    x[500:520] = x[500] * np.arange(1, 21, dtype=np.float32)[:, None]
    rows = [(i, v.tolist(), "k", 0) for i, v in enumerate(x)]
    bad = [(n, None, "", 1), (n + 1, [0.0] * dim, "", 1), (n + 2, [None] + [1.0] * (dim - 1), "", 1), (n + 3, [float("nan")] + [1.0] * (dim - 1), "", 1), (n + 4, [float("inf")] * dim, "", 1), (None, [1.0] * dim, "", 1), (5000, [1.0, 2.0], "", 1), (5050, [2.0, 4.0], "", 1), (n + 5, [], "", 1)]
    return x, rows + bad


def test_nearest(spark, monkeypatch):
    x, rows = vectors()
    monkeypatch.setattr(hnsw, "QUERY_BLOCK", 16)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard string, dim int").repartition(4)
    got = {}
    graphs = hnsw.index(df, shard=512)
    assert graphs.count() >= 6
    monkeypatch.setattr(hnsw, "SHARD", 512)
    for r in hnsw.nearest(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    d = x.astype(float)
    unit = d / np.sqrt((d**2).sum(1, keepdims=True))
    hit = total = 0
    for q in range(0, 3000, 50):
        sims = unit @ unit[q]
        sims[q] = -9
        mine = sorted(got[q])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        assert all(abs(sims[i] - s) < 1e-12 for _, i, s in mine) and q not in {i for _, i, _ in mine}
        best = np.sort(sims)[-5:]
        hit += sum(s >= best[0] - 1e-12 for _, _, s in mine)
        total += 5
    assert hit / total >= 0.95
    assert [(i, round(s, 9)) for _, i, s in got[5000]] == [(5050, 1.0)] and [i for _, i, _ in got[5050]] == [5000]
    assert not {3000, 3001} & set(got)
    assert [i for _, i, _ in sorted(got[150])] == [100, 101, 102, 103, 104]  # ties go to smaller identifiers
    assert hnsw.nearest(df.limit(0), df.limit(0)).count() == 0
    assert hnsw.nearest(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0


def test_recall_over_several_shards(spark):
    x, rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard string, dim int").repartition(4)
    assert hnsw.index(df.where("vec_id < 3000"), shard=512).count() >= 6
    got = {}
    for r in hnsw.nearest(df, df.where("vec_id % 50 = 0 and vec_id < 3000"), shard=512).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = 0
    for q in range(0, 3000, 50):
        sims = unit @ unit[q]
        sims[q] = -9
        assert [m[0] for m in sorted(got[q])] == [1, 2, 3, 4, 5]
        hit += sum(s >= np.sort(sims)[-5] - 1e-12 for _, _, s in got[q])
    assert hit / 300 >= 0.95
