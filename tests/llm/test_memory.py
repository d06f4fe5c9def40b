"""What a task of the census, or the driver, holds at once."""

import subprocess
import sys
import tracemalloc
import zlib
from types import SimpleNamespace

import numpy as np
import pandas as pd

import corpus_pipeline
from loomstat.llm import chunks, common, jaccard_join, substring_dedup, token_output, toxicity


def peak(run):
    tracemalloc.start()
    try:
        out = run()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_merging_a_bucket_takes_a_few_bytes_for_each_key():
    rng = np.random.default_rng(3)
    parts = [np.sort(rng.choice(1 << 20, 1 << 17, replace=False)).astype(np.uint64) for _ in range(6)]
    counts = [rng.integers(1, 70_000, len(p)) for p in parts]
    rows = pd.concat([chunks.census_rows(i, p, c) for i, (p, c) in enumerate(zip(parts, counts, strict=True))], ignore_index=True)
    got, most = peak(lambda: chunks._merge(rows))
    total = np.zeros(1 << 20, np.int64)
    for p, c in zip(parts, counts, strict=True):
        total[p.astype(np.int64)] += c
    for i, p in enumerate(parts):
        table, numbers = chunks.answers(got[got["chunk"] == i])
        known = p[total[p.astype(np.int64)] > 1]
        assert (table == known).all() and (numbers == total[known.astype(np.int64)]).all()
    assert most < 50 * sum(map(len, parts))


def test_a_chunk_s_keys_are_counted_in_place():
    rng = np.random.default_rng(4)
    every = chunks.squeeze(rng.integers(0, 1 << 63, 1 << 18).astype(np.uint64), 7)
    every = np.concatenate([every, every[: 1 << 16], every[:5]])
    want = chunks.census_rows(1, *np.unique(every, return_counts=True))
    got, most = peak(lambda: chunks.counted_rows(1, every))
    pd.testing.assert_frame_equal(got, want)
    assert most < 2 * every.nbytes
    assert not len(chunks.counted_rows(1, every[:0]))


def test_a_shingler_keeps_a_bounded_number_of_words():
    shingle = jaccard_join.Shingler()
    texts = [b" ".join(b"w%d" % (k * 1000 + i) for i in range(1000)) for k in range(300)]
    kept = [shingle(t) for t in texts]
    assert len(shingle.words) <= (1 << 17) + 1000
    assert all((a == jaccard_join.Shingler()(t)).all() for a, t in zip(kept[::50], texts[::50], strict=True))


def test_training_keeps_no_object_for_each_gram_on_the_driver(spark):
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzäöüßéèêáàóòúùñçABCDEFG0123456789"))
    docs = spark.createDataFrame([(i, "".join(rng.choice(letters, 600))) for i in range(160)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(160)], "doc_id long, toxic int")
    arrow = spark.conf.get("spark.sql.execution.arrow.pyspark.enabled")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")  # Spark's default
    try:
        model, most = peak(lambda: toxicity.train(docs, labels))
    finally:
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", arrow)
    grams = sum(len(keys) for keys, _ in model.tables)
    assert grams > 50_000 and all((np.diff(keys) > 0).all() and (counts > 0).all() for keys, counts in model.tables)
    assert most < 100 * grams + (6 << 20)


def test_partners_that_can_t_link_aren_t_sent_on():
    rng = np.random.default_rng(6)
    sets = 300
    n, l = rng.choice([20, 24, 60, 400], sets), rng.choice([1, 2, 8], sets)
    of = rng.integers(1, 5, sets)
    members = (np.arange(sets), n, rng.integers(-20, 9, sets), l, np.arange(sets) // 3, of)
    minors = tuple(x[::2] for x in members)
    got, want = {}, {}
    for z, sig, need, root in jaccard_join._met(minors, members, 75, True):
        sig = np.frombuffer(sig, np.int64)
        assert (np.frombuffer(root, np.int64) == sig // 3).all()
        got |= dict(zip([(z, s) for s in sig.tolist()], chunks.unpack_counts(need, len(sig)).tolist(), strict=True))
    for z, zn, zover, zl, zroot, zof in zip(*(x.tolist() for x in minors), strict=True):
        for s, sn, over, sl, root, so in zip(*(x.tolist() for x in members), strict=True):
            if (so, root) > (zof, zroot) and 100 * min(sn, zn) >= 75 * max(sn, zn) and max(over, zover) < min(sl, zl):
                want[z, s] = int(jaccard_join.least_shared(sn, zn, min(sl, zl)))
    assert got == want and 0 < len(got) < sets * sets // 16


def test_hashes_of_segments_are_made_in_stretches_that_stay_in_cache():
    rng = np.random.default_rng(7)
    sizes = rng.integers(0, 9000, 400)
    data = rng.integers(97, 100, sizes.sum()).astype(np.uint8)
    s, most = peak(lambda: substring_dedup.Segments(data, sizes, 50, 28))
    kept = sum(x.nbytes for x in (s.start, s.windows, s.text, s.anchor, s.content))
    assert most < 2.5 * kept + (8 << 20)
    whole = [substring_dedup.Segments(data[e - n : e], np.array([n]), 50, 28) for e, n in zip(np.cumsum(sizes), sizes, strict=True)]
    assert (np.concatenate([w.content for w in whole]) == s.content).all() and (np.concatenate([w.windows for w in whole]) == s.windows).all()


def test_rows_go_to_python_in_batches_of_bounded_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pd.DataFrame({"bytes": [int(b["text"].str.len().sum())]})

    docs = spark.range(0, 6000, 1, 1).selectExpr("repeat(cast(id % 10 as string), 2000) AS text")
    before = spark.conf.get(common.BATCH)
    got = [r["bytes"] for r in common.stored(docs.mapInPandas(sizes, "bytes long"), "sizes").collect()]
    assert sum(got) == 12_000_000 and max(got) < 3 << 20
    assert spark.conf.get(common.BATCH) == before


HELD = """
import sys
from pathlib import Path
import numpy as np
from loomstat.llm.common import give_back

def held():
    return int(Path("/proc/self/statm").read_text().split()[1]) * 4096

if sys.argv[1] == "1":
    give_back()
np.ones(30 << 20, np.uint8)  # freed at once: glibc now keeps arrays up to this size
before = held()
arrays = [np.ones(20 << 20, np.uint8) for _ in range(5)]
small = bytes(2000), [bytes(700 + i) for i in range(50)]
del arrays
print(held() - before)
"""


def test_a_worker_that_waits_gives_freed_arrays_back():
    kept = [int(subprocess.run([sys.executable, "-c", HELD, x], capture_output=True, text=True, check=True).stdout) for x in "01"]
    assert kept[1] < 4 << 20 and kept[0] > kept[1] + (16 << 20)


def test_an_encoder_stays_for_its_own_tasks_only():
    path = token_output.default_vocabulary()
    first = token_output.encoder(path)
    common.give_back("token_output")
    assert token_output.encoder(path) is first
    common.give_back()
    assert token_output.encoder(path) is not first and token_output.encoder(path)("one two") == first("one two")


def test_an_encoder_s_memos_stay_small_beside_the_jvm():
    letters = "abcdefghij"
    words = ["".join(letters[int(d)] for d in f"{i:06d}") for i in range(700_000)]
    encode = token_output.Encoder(token_output.default_vocabulary(), token_output.SMALL_MEMO)
    texts = [" ".join(words[at : at + 1000]) for at in range(0, len(words), 1000)]
    # all words and their ids take 107 MB
    ids, most = peak(lambda: [zlib.crc32(encode(t)) for t in texts])
    assert most < 64 << 20
    odd = [*texts[::90], "one Two\nthree four", " five  six ", "Größe naïve 'tis don't 7up x y ₂ ﬁn", ""]
    whole = [np.array(encode.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32).tobytes() for t in odd]
    assert [encode(t) for t in odd] == whole
    assert ids[::90] == [zlib.crc32(w) for w in whole[: len(ids[::90])]]


def test_the_pipeline_s_workers_keep_the_small_memos(spark, tmp_path, monkeypatch):
    asked = []
    monkeypatch.setattr(type(spark.range(0)), "mapInPandas", lambda self, f, schema: asked.append(f) or spark.range(0))
    monkeypatch.setattr(token_output, "read_tokens", lambda manifest: manifest)
    corpus_pipeline.write_tokens(spark, spark.createDataFrame([(1, "one two")], "doc_id long, text string"), str(tmp_path))
    write = asked.pop()
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: SimpleNamespace(partitionId=lambda: 0))
    monkeypatch.setattr(token_output, "encoder", lambda *a: asked.append(a))
    assert not list(write(iter([]))) and asked == [(token_output.default_vocabulary(), token_output.SMALL_MEMO)]
    assert token_output.SMALL_MEMO < token_output.MEMO


def test_reading_shards_drops_the_encoder(spark, tmp_path, monkeypatch):
    manifest = token_output.write_tokens(spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string"), folder=f"file://{tmp_path}/t", shards=2)
    rows, tasks = manifest.selectExpr("path", "0L AS before").toPandas(), []
    monkeypatch.setattr(type(manifest), "mapInPandas", lambda self, f, schema: tasks.append(f))
    token_output.read_tokens(manifest)
    token_output.encoder(token_output.default_vocabulary())
    read = pd.concat(tasks[0](iter([rows])))
    assert sorted(read["doc_id"]) == [1, 2] and not common.KEPT["token_output"]
