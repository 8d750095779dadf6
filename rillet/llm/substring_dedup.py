"""Substring deduplication by level-wise doubling.

A word is removed if a window of WINDOW consecutive words that covers it also starts in a document with a smaller
identifier. Levels are windows of 13, 25 and 50 words (each about twice the one before): a place whose window is not
repeated in another document at one level is never looked at on the next.

1. Every whole text is hashed once. Of the first level, only the windows are indexed that have the least hash among
   those of some window of WINDOW words (equal long windows choose equal short ones, so none is lost; about 1 place in
   19 remains). Documents that are equal word for word are represented by the smallest identifier; the others go whole.
2. Level 13: places repeated in two documents survive. Level 25: the survivors' windows to the right and to the left;
   one of them lies within any long window, so a place survives if either is repeated.
3. Level 50: first the stretch of all long windows that chose the same place is compared whole: if an earlier document
   has the stretch, it is covered. The first document of each distinct stretch then has its windows of WINDOW words
   compared one by one, under 128-bit hashes, with those of the other distinct stretches.
4. Covered words are cut from the texts.

Groups are keyed by hashes; keys with more than a thousandth of the rows are looked up by broadcast (at most a
thousand of them), the others by shuffle, and minima are gathered with partial aggregation.

Defined results: null text has no words; documents of fewer than WINDOW words keep them all; rows that repeat an
identifier do not cover one another; a row with a null identifier neither covers nor is cut; an empty table gives an
empty result; `cut` keeps other columns.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import drop, lookup, stage

WINDOW = 50
EMPTY = hashlib.sha256(b"").hexdigest()
ANCHOR = "struct<h1:bigint,r2:bigint,l2:bigint,b1:bigint,b2:bigint,lo:int,hi:int>"


def levels(window: int) -> tuple[int, int]:
    half = (window + 1) // 2
    return (half + 1) // 2, half


def _anchors(words: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """For each document the number of its anchors, and their columns."""
    k1, k2 = levels(window)
    n_docs = len(first) - 1
    counts = np.diff(first)
    doc = np.repeat(np.arange(n_docs), counts)
    if len(words) < window:
        return np.zeros(n_docs, np.int64), {c: np.zeros(0, np.int64) for c in ("h1", "r2", "l2", "b1", "b2", "lo", "hi")}
    h1 = W.window_hashes(words, k1)
    place = np.arange(len(words) - window + 1)
    whole = doc[place] == doc[place + window - 1]
    chosen = W.sliding_argmin(h1, window - k1 + 1)[place]
    place, chosen = place[whole], chosen[whole]
    if not len(place):
        return np.zeros(n_docs, np.int64), {c: np.zeros(0, np.int64) for c in ("h1", "r2", "l2", "b1", "b2", "lo", "hi")}
    new = np.ones(len(place), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (place[1:] != place[:-1] + 1)
    at = np.flatnonzero(new)
    lo, hi, a = place[at], place[np.append(at[1:], len(place)) - 1], chosen[at]
    h2 = W.window_hashes(words, k2)
    end, begin = first[1:][doc[a]], first[:-1][doc[a]]
    has_r, has_l = a + k2 <= end, a + k1 - k2 >= begin
    # where a window would leave the document, a value that is the document's own
    own = W.mix((doc[a] + 1).astype(np.uint64) * np.uint64(W.SECOND) ^ words[begin] ^ a.astype(np.uint64))
    r2 = np.where(has_r, h2[np.minimum(a, len(h2) - 1)], own)
    l2 = np.where(has_l, h2[np.maximum(a + k1 - k2, 0)], own)
    out = {"h1": h1[a], "r2": r2, "l2": l2}
    # the stretch: all words from lo to hi + window, with the anchor's place in it
    for name, base in (("b1", W.FIRST), ("b2", W.SECOND)):
        power, inverse = W.powers(base, len(words))
        sums = W._sums(words * power)
        out[name] = W.mix(W.mix((sums[hi + window] - sums[lo]) * inverse[lo]) + (hi - lo).astype(np.uint64) * np.uint64(W.BYTES))
    out = {k: v.view(np.int64) for k, v in out.items()}
    return np.bincount(doc[a], minlength=n_docs), out | {"lo": lo - begin, "hi": hi - begin}


def _index(window: int):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").fill_null("")
            data, offsets = W.text_buffers(texts)
            raw = data.tobytes()
            n_words, sha, counts, parts = [], [], [], []
            for i in range(len(texts)):
                found = raw[offsets[i] : offsets[i + 1]].split()
                n_words.append(len(found))
                sha.append(hashlib.sha256(b" ".join(found)).hexdigest())
            for a, b in W.slices(offsets):
                hashes, first = W.word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n, cols = _anchors(hashes, first, window)
                counts.append(n)
                parts.append(cols)
            lists = np.append(0, np.cumsum(np.concatenate(counts))) if counts else np.zeros(1, np.int64)
            kinds = {"lo": pa.int32(), "hi": pa.int32()}
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64), pa.int64()).cast(kinds.get(c, pa.int64())) for c in ("h1", "r2", "l2", "b1", "b2", "lo", "hi")], ["h1", "r2", "l2", "b1", "b2", "lo", "hi"])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tx"), pa.array(n_words, pa.int64()), pa.array(sha), pa.ListArray.from_arrays(pa.array(lists, pa.int32()), flat)], ["id", "tx", "n_words", "sha", "anchors"])

    return run


def _places(window: int):
    """The windows of given stretches, each with a 128-bit hash."""

    def run(batches):
        for batch in batches:
            data, offsets = W.text_buffers(batch.column("text"))
            ids, tx, spans = batch.column("id"), batch.column("tx"), batch.column("spans").to_pylist()
            rows, c1, c2, at = [], [], [], []
            for a, b in W.slices(offsets):
                hashes, first = W.word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                w1, w2 = W.window_hashes(hashes, window), W.window_hashes(hashes, window, W.SECOND)
                for i in range(a, b):
                    p = np.concatenate([np.arange(s["lo"], s["hi"] + 1) for s in spans[i]])
                    rows.append(np.full(len(p), i))
                    at.append(p)
                    c1.append(w1[p + first[i - a]])
                    c2.append(w2[p + first[i - a]])
            if rows:
                which = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([ids.take(which), tx.take(which), pa.array(np.concatenate(c1).view(np.int64)), pa.array(np.concatenate(c2).view(np.int64)), pa.array(np.concatenate(at), pa.int32())], ["id", "tx", "w1", "w2", "at"])

    return run


def _kept(batches):
    """Texts without the words of the given spans [from, to): the words that stay, and how many went."""
    for batch in batches:
        texts, spans = batch.column("text").to_pylist(), batch.column("spans").to_pylist()
        n_removed, kept = [], []
        for text, cut in zip(texts, spans):
            found = (text or "").encode().split()
            keep = np.ones(len(found), bool)
            for s in cut or ():
                keep[s["lo"] : s["hi"]] = False
            n_removed.append(int(len(found) - keep.sum()))
            kept.append(b" ".join([found[i] for i in np.flatnonzero(keep)]).decode())
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n_removed, pa.int64()), pa.array(kept)], ["row", "n_removed", "kept"])


def text_hash(text: str):
    """Tells rows apart that share an identifier."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tx")


def _repeated(rows: DataFrame, key: list[str], total: int) -> DataFrame:
    """Of rows (with a column id), those whose key occurs under two identifiers at least."""
    facts = stage(rows.groupBy(*key).agg(F.min("id").alias("__a"), F.max("id").alias("__b"), F.count("*").alias("__n")).where("__a < __b").select(*key, "__n"), "substring-level")
    return lookup(rows, facts, key, "__n", total).where("__n is not null").drop("__n")


def covered(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(index, spans): per document id, n_words, sha, n_rows-smallest id of equal documents; and (id, lo, hi) of words that go."""
    k1, k2 = levels(window)
    base = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), text_hash(text))
    id_type = base.schema["id"].dataType.simpleString()
    index = stage(base.mapInArrow(_index(window), f"id {id_type}, tx long, n_words long, sha string, anchors array<{ANCHOR}>"), "substring-index")
    n_docs = index.count()
    copies = stage(index.groupBy("sha").agg(F.min("id").alias("rep"), F.count("*").alias("__n")).where("__n > 1"), "substring-copies")
    with_rep = lookup(index.select("id", "tx", "n_words", "sha"), copies, ["sha"], "__n", n_docs).drop("__n")
    copied = stage(with_rep.withColumn("copy", F.coalesce(F.col("rep") < F.col("id"), F.lit(False))).drop("rep"), "substring-docs")
    dropped = copied.where("copy").select("id", "tx")
    rows = index.where(F.size("anchors") > 0).join(dropped, ["id", "tx"], "left_anti").select("id", "tx", F.inline("anchors"))
    one = stage(rows, "substring-level-0")
    total = one.count()
    # level 1, then level 2 to either side
    two = stage(_repeated(one, ["h1"], total), "substring-level-1")
    right = _repeated(two, ["r2"], total)
    left = _repeated(two, ["l2"], total)
    three = stage(right.unionByName(left).select("id", "tx", "b1", "b2", "lo", "hi").distinct(), "substring-level-2")
    # level 3: whole stretches, then window by window for the first document of each stretch
    stretch = ["b1", "b2"]
    firsts = stage(three.groupBy(*stretch).agg(F.min("id").alias("first"), F.count("*").alias("__n")), "substring-stretch")
    marked = stage(lookup(three, firsts, stretch, "__n", total), "substring-stretches")
    whole = marked.where(F.col("first") < F.col("id")).select("id", "tx", "lo", (F.col("hi") + window).alias("hi"))
    lone = marked.where(F.col("first") == F.col("id")).groupBy("id", "tx").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    places = stage(base.join(lone, ["id", "tx"]).select("id", "tx", "text", "spans").mapInArrow(_places(window), f"id {id_type}, tx long, w1 long, w2 long, at int"), "substring-windows")
    n_places = places.count()
    mins = stage(places.groupBy("w1", "w2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("__n")).where("first < last").drop("last"), "substring-windows-first")
    single = lookup(places, mins, ["w1", "w2"], "__n", n_places).where(F.col("first") < F.col("id")).select("id", "tx", F.col("at").alias("lo"), (F.col("at") + window).alias("hi"))
    spans = stage(whole.unionByName(single), "substring-spans")
    drop(index, copies, one, two, three, firsts, marked, places, mins)
    return copied, spans


def _cut_rows(docs: DataFrame, text: str, key: str, window: int) -> tuple[DataFrame, DataFrame]:
    copied, spans = covered(docs, text, key, window)
    return copied, spans.groupBy("id", "tx").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def cut(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """docs with the covered words removed: texts that lose words become the other words joined by one space."""
    copied, per_doc = _cut_rows(docs, text, key, window)
    gone = copied.where(F.col("copy") & (F.col("n_words") >= window)).select("id", "tx").distinct().withColumn("__gone", F.lit(True))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("id"), F.col(text).alias("text"), text_hash(text))
    row = row.join(gone, ["id", "tx"], "left").withColumn("text", F.when(F.col("__gone"), F.lit("")).otherwise(F.col("text")))
    touched = row.join(per_doc, ["id", "tx"]).select("row", "text", "spans")
    whole = row.join(per_doc.select("id", "tx"), ["id", "tx"], "left_anti").select("row", "text")
    changed = touched.mapInArrow(_kept, touched.select("row").schema.add("n_removed", "long").add("kept", "string")).select("row", F.col("kept").alias("text"))
    other = [F.col(f"row.`{c}`").alias(c) if c != text else F.col("text").alias(text) for c in docs.columns]
    return changed.unionByName(whole).select(*other)


def report(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """key, n_words, n_removed and the digest of the words that stay, for each document."""
    copied, per_doc = _cut_rows(docs, text, key, window)
    light = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), text_hash(text)).withColumn("row", F.struct("id", "tx"))
    touched = light.join(per_doc, ["id", "tx"]).select("row", "text", "spans")
    changed = touched.mapInArrow(_kept, touched.select("row").schema.add("n_removed", "long").add("kept", "string"))
    changed = changed.select(F.col("row.id").alias("id"), F.col("row.tx").alias("tx"), "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha")).dropDuplicates(["id", "tx"])
    gone = F.col("copy") & (F.col("n_words") >= window)
    both = copied.join(changed, ["id", "tx"], "left")
    return both.select(
        F.col("id").alias(key), "n_words", F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
    )
