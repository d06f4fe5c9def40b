"""The text operators against brute force, exact round trips and edge cases, on small fixtures."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomstat.llm import chat_format, chunks, decontamination, exact_dedup, jaccard_join, lattice_lm, mixing, substring_dedup, token_output, toxicity, url_filter
from loomstat.llm.queries import CATALOGUE

SCHEMA = "doc_id long, text string, lang string, source string, keep_id string, chunk int"


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Random texts with copies, near copies, nulls, empty and long texts, repeated rows."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(["th", "er", "on", "é", "an", "日"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    texts: list[str | None] = []
    for i in range(n):
        kind = i % 6
        if kind == 1 and texts[-1]:
            texts.append(texts[-1].replace(" ", " \n\t", 1))
        elif kind == 2 and texts[-2]:
            w = texts[-2].split()
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(rng.choice(words) for _ in range(rng.choice([3, 12, 60, 150]))))
    texts += [None, "", "   ", "one two", "one two", "ONE Two", " ".join(words * 8)]
    rows = [(i, t, "en" if i % 2 else None, ["a", "b", None][i % 3], "x", 1) for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, texts[4], None, None, "y", 2)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(text))


def test_cuckoo_index_inserts_deletes_and_grows():
    index, live = exact_dedup.CuckooIndex(2), {}
    rng = random.Random(5)
    for i in range(3000):
        d = hashlib.sha256(str(rng.randrange(900)).encode()).digest()
        if rng.random() < 0.6:
            index.insert(d, i)
            live[d] = i
        else:
            assert index.delete(d) == (live.pop(d, None) is not None)
    assert index.resizes and dict(index.items()) == live and index.size == len(live)
    assert all(index.get(d) == v for d, v in live.items()) and index.get(b"\0" * 32) is None


def test_exact_dedup(docs, rows, none):
    groups: dict[bytes, list] = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "").encode(), []).append(r[0])
    expected = Counter()
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        expected.update((i, keep, len(ids), hashlib.sha256(text).hexdigest()) for i in ids)
    got = exact_dedup.exact_dedup(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expected
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_index_update(spark):
    schema = "doc_id long, text string"
    old = spark.createDataFrame([(1, "a b"), (2, "a  b"), (3, "c"), (None, "d"), (9007199254740993, "e")], schema)
    gone = spark.createDataFrame([(1, "a b"), (3, "c"), (77, "d"), (None, "never")], schema)
    new = exact_dedup.update_index(exact_dedup.build_index(old), spark.createDataFrame([(4, "d"), (4, "d")], schema), gone)
    digest = lambda t: hashlib.sha256(t).digest()
    assert {bytes(r.digest): (r.live, r.keep_id) for r in exact_dedup.live_digests(new).collect()} == {digest(b"a b"): (1, 2), digest(b"d"): (3, 4), digest(b"e"): (1, 9007199254740993)}


def test_large_ids_beside_nulls_stay_exact(spark):
    big = 9007199254740993
    text = "a text of some words that is long enough to have five word shingles and more than fifty bytes"
    docs = spark.createDataFrame([(big, text), (None, "b"), (big + 2, text), (None, text + " x")], "doc_id long, text string").coalesce(1)
    for out in (exact_dedup.exact_dedup(docs), substring_dedup.remove_repeats(docs), jaccard_join.jaccard_components(docs), lattice_lm.lattice_scores(docs, rounds=0), token_output.token_output(docs)):
        assert Counter(r.doc_id for r in out.collect()) == Counter([big, big + 2, None, None])
    assert {r.keep_id for r in exact_dedup.exact_dedup(docs).collect()} == {big, None}
    assert {r.component_id for r in jaccard_join.jaccard_components(docs).collect()} == {big, None}


def test_substring_dedup(docs, rows, none):
    smallest: dict[bytes, int] = {}
    key = lambda i: 2**63 if i is None else i
    for r in rows:
        b = (r[1] or "").encode()
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            smallest[w] = min(smallest.get(w, 2**63), key(r[0]))
    expected = Counter()
    for r in rows:
        b = (r[1] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if smallest[b[i : i + 50]] < key(r[0]):
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        expected[r[0], len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()] += 1
    got = substring_dedup.remove_repeats(docs).drop("spans").collect()
    assert Counter(map(tuple, got)) == expected and any(r.n_spans for r in got)
    assert substring_dedup.remove_repeats(none).count() == 0


def test_run_index_handles_foreign_patterns():
    strings = [b"abracadabra", b"cadabra"]
    index = substring_dedup.RunIndex(strings, np.array([5, 3]), 4)
    pattern = np.frombuffer(b"xcadabz", np.uint8).astype(np.int64)[None, :] + 1
    sizes = {j: int(s[0]) for j, s, _ in index.stream(pattern)}
    assert sizes == {6: 0, 5: 1, 4: 2, 3: 3, 2: 4, 1: 5, 0: 0} or sizes[1] == 5


def test_jaccard_join(docs, rows, none):
    sets = []
    for r in rows:
        w = split(r[1])
        sets.append(frozenset(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    expected = Counter()
    for i, r in enumerate(rows):
        members = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        expected[r[0], len(sets[i]), min(members, default=None)] += 1
    assert Counter(map(tuple, jaccard_join.jaccard_components(docs).collect())) == expected
    assert jaccard_join.jaccard_components(none).count() == 0


def test_census_counts_are_exact():
    keys, counts = np.array([3, 8, (1 << 40) + 5], np.uint64), np.array([70_000, 65_535, 2**32 + 1])
    sent = [chunks.census_rows(i, keys, counts) for i in range(2)]
    replies = [chunks._merge(b) for _, b in pd.concat(sent).groupby("bucket")]
    for i in range(2):
        found, total = chunks.answers(pd.concat([r[r["chunk"] == i] for r in replies]))
        assert found.tolist() == keys.tolist() and total.tolist() == (2 * counts).tolist()


def test_near_copy_of_a_set_with_many_copies(spark):
    text = "a b c d e f g h"
    docs = spark.range(66_000).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(-1, text + " i"), (-2, "p q r s t u v")], "doc_id long, text string"))
    # one partition, hence one chunk, which alone holds more copies than 16 bits count
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        got = jaccard_join.jaccard_components(docs).groupBy("component_id").count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r.component_id: r["count"] for r in got} == {-1: 66_001, -2: 1}


def test_crossing_pairs_over_many_blocks(spark, monkeypatch):
    rng = random.Random(5)
    sets = {s: (rng.choice([8, 10, 12, 40]), rng.choice([1, 2])) for s in range(60)}
    # token 0 is in every set
    held = {s: {t: rng.randint(-3, 1) for t in [0, *rng.sample(range(1, 12), 4)]} for s in sets}
    roots = {s: 0 if s < 10 else 10 for s in range(15)}
    posts = spark.createDataFrame([(t, s, sets[s][0], over, sets[s][1]) for s in sets for t, over in held[s].items()], "token long, sig long, n long, over long, l long")
    named = spark.createDataFrame(list(roots.items()), "sig long, root long")
    expected = set()
    for a in sets:
        for b in range(a + 1, len(sets)):
            (n, l), (m, k) = sets[a], sets[b]
            least = min(l, k)
            shared = sum(max(held[a][t], held[b][t]) < least for t in held[a].keys() & held[b].keys())
            if roots.get(a, a) != roots.get(b, b) and 100 * min(n, m) >= 75 * max(n, m) and shared >= jaccard_join.least_shared(n, m, least):
                expected.add((a, b))
    assert len(expected) > 50
    for size in (3, 2048):
        monkeypatch.setattr(jaccard_join, "LIST", size)
        assert set(map(tuple, jaccard_join._crossing_pairs(posts, named, 75, False).collect())) == expected


def test_near_copies_of_a_group_aren_t_all_compared(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(300)]

    def changed(times):
        words = list(base)
        for k in range(times):
            words[rng.randrange(len(words))] = f"x{rng.random()}"
        return words

    # most link with the least changed ones, some with a few others only, some with none
    texts = [changed(rng.choice([1, 2, 3, 3, 4, 4, 5, 6, 7, 12])) for _ in range(240)]
    sets = [frozenset(zip(*[w[k:] for k in range(5)], strict=False)) for w in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    root = list(range(len(sets)))
    for i, j in links:
        a, b = sorted((root[i], root[j]))
        root = [a if r == b else r for r in root]
    assert len(links) > 30 * len(sets) and len(set(root)) > 1
    compared, verified = [], jaccard_join._verified

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(jaccard_join, "_verified", counted)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()} == dict(enumerate(root))
    assert sum(compared) < 8 * len(sets)


def test_url_filter(spark):
    rng = random.Random(3)
    hosts = ["example.net", "a.example.net", "notexample.net", "x.org", "org", "m.spam-x.com", "example.com", "EXAMPLE.COM", "net", ".net", "net.org:80"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en', '/de/x', '/fr/?q', '#/en/', '?/de/', '/x.net/'])}" for _ in range(300)] + [None, "", "no scheme", "://", "http://é.net/" + "a" * 5000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in url_filter.filter_urls(df).collect():
        u = urls[r.page_id] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        raw = re.match(r"[^/?#]*", rest)[0]
        host, path = lowered(raw), re.match(r"[^?#]*", rest[len(raw) :])[0]
        fits = [x for x in url_filter.RULES if ("." + host).endswith("." + x.host) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.name), default=None)
        verdict = best.verdict if best else "block" if any("." + s in "." + host for s in url_filter.SUSPECT) else "allow"
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best.name, verdict)


def test_automaton_over_words():
    globs = [(f"*.h{i}?.com", f"/p{i}*end") for i in range(40)]
    automaton = url_filter.Automaton(globs)
    assert automaton.enter.shape[0] > 5
    text = np.array([*b".a.h37x.com", url_filter.SEPARATOR, *b"/p37--end"], np.uint16)
    assert list(np.flatnonzero(automaton.matches([text])[0])) == [37]


def test_mixing(docs, rows, none):
    got = mixing.mixed(docs).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(split(r[1]))) for r in rows)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    assert sum({(r.source_size, r.target): r.target for r in got}.values()) == pytest.approx(sum(r.size for r in got))
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mixed(docs).collect()), key=str)
    assert mixing.mixed(none).count() == 0


def test_chat_round_trip(spark):
    rng = random.Random(2)
    parts = ["\\", "### ", "</turn>", "\n", ": ", "Assistant", "a", "#", "<", "é"]
    text = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", text()]), text()) for _ in range(rng.randint(0, 4))]
        rendered, spans = chat_format.render(turns)
        assert chat_format.parse(rendered) == turns
        assert [chat_format.unescape(rendered[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    df = spark.createDataFrame([(1, 1, "assistant", None), (1, 0, None, "q"), (None, None, "user", "</turn>")], "conv_id long, turn int, role string, text string")
    assert {r.conv_id: r.n_turns for r in chat_format.read_back(chat_format.format_conversations(df)).collect()} == {1: 2, None: 1}


def test_lattice_sums_all_segmentations(spark):
    pieces = [f"<0x{b:02X}>" for b in range(256)] + ["▁", "▁a", "a", "b", "ab", "▁ab", "bab"]
    p = np.full((len(pieces), 2), 1.0 / len(pieces))
    p[256:, 1] = np.arange(1, 8) / 28
    lattice = lattice_lm.Lattice(pieces, p)

    def brute(text, c):
        if not text:
            return 1.0
        total = sum(p[i, c] * brute(text[len(x) :], c) for i, x in enumerate(pieces) if i >= 256 and text.startswith(x))
        if text[0] not in pieces:
            total += math.prod(p[b, c] for b in text[0].encode()) * brute(text[1:], c)
        return total

    for word in ["a", "abab", "éab", "b日", "ab" * 30]:
        for c in (0, 1):
            if len(word) < 10:
                assert lattice.logs([word])[0, c] == pytest.approx(math.log(brute("▁" + word, c)))
    assert np.isfinite(lattice.logs(["ab" * 2000])).all()
    counts = lattice.expected(["ab"], np.array([[2.0, 0.0]]))
    assert counts[:, 1].sum() == 0 and counts[:, 0].sum() > 2


def test_short_words_below_the_least_double():
    pieces = [f"<0x{b:02X}>" for b in range(256)] + ["▁", "a"]
    p = np.full((len(pieces), 2), 1e-10)
    p[:, 1] = 1 / len(pieces)
    p[256] = 0.5
    lattice = lattice_lm.Lattice(pieces, p)
    for word, n in [("a" * 36, 36), ("አ" * 12, 36), ("b", 1)]:
        each = lattice.logs([word, "a"])
        assert each[0] == pytest.approx(math.log(0.5) + n * np.log(p[0]))
        # as many as the word has, where it is counted, and none in the other component
        for times in ([0.0, 3.0], [3.0, 0.0]):
            counts = lattice.expected([word, "a"], np.array([times, [1.0, 1.0]]))
            assert counts[256] == pytest.approx(np.array(times) + 1)
            bytes_of = [b for c in word if c != "a" for b in c.encode()]
            assert counts[:256].sum(axis=0) == pytest.approx(np.array(times) * len(bytes_of))
            assert counts[257] == pytest.approx(1 + np.array(times) * word.count("a"))


def test_lattice_scores(docs, rows, none):
    train = Counter()
    for r in rows:
        if zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 5 != 1:
            train.update([*split(r[1]), None])
    total, kinds = sum(train.values()), len(train)
    expected = sorted((len(w), sum(train[x] > 0 for x in w), total, round(sum(math.log10((train[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w), 6)) for r in rows for w in [[*split(r[1]), None]])
    got = lattice_lm.lattice_scores(docs, rounds=1).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    assert all(r.score < 0 for r in got)
    assert lattice_lm.lattice_scores(none).count() == 0


def test_token_files(docs, rows, spark, none, tmp_path):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(token_output.default_vocabulary())
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    ids = [np.array([*encode.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4") for r in order]
    starts = np.cumsum([0, *map(len, ids)])
    expected = [(r[0], int(s), len(x), zlib.crc32(x.tobytes())) for r, s, x in zip(order, starts, ids, strict=False)]
    manifest = token_output.write_tokens(docs, folder=f"file://{tmp_path}/t", docs_per_frame=4, shards=3)
    assert sorted(map(tuple, token_output.read_tokens(manifest).collect()), key=lambda r: r[1]) == expected
    assert token_output.token_output(none).count() == 0
    path = manifest.orderBy("shard").first().path.removeprefix("file://")
    wanted = [i for i, _ in token_output.Shard(path).documents(lambda i: i == 3)]
    assert wanted == [3, 3]
    data = bytearray(open(path, "rb").read())
    data[5] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(ValueError, match="damaged"):
        list(token_output.Shard(path).documents())


def test_encoder_agrees_with_the_library():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(token_output.default_vocabulary())
    rng, own = random.Random(4), token_output.Encoder(token_output.default_vocabulary())
    parts = [" ", "  ", "\n", "\t", " ", "　", "a", "word", "it's", "12", "é", "日本", "!", "<|endoftext|>", "\x1c", "\x85", "🙂"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in map(own, texts)] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_encoder_agrees_with_the_plain_call():
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(token_output.default_vocabulary()), token_output.Encoder(token_output.default_vocabulary())
    ids = lambda text: np.frombuffer(own(text), "<u4").tolist()
    words = ["stone", "day", "verse", "tone", "reel", "llama", "m", "é", "日本", "ªº", "ǅ"]
    texts = [start + word + rest for start in ["", "'", "’", "1", "!", "\n", "\t", "\u3000", "_", "''", "²"] for word in words for rest in ["", " ", " 'stone 'day", "\nverse"]]
    assert list(map(ids, texts)) == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    for text in ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>'s"]:
        assert 50256 in ids(text) and ids(text) == plain.encode(text, add_special_tokens=False).ids


def test_toxicity(spark, none):
    rng = random.Random(6)
    plain = ["the", "of", "and", "house", "river", "green", "walks", "slowly"]
    rows = [(i, " ".join(rng.choice(plain) for _ in range(40)) + (" you idiot moron " if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)] + [(400, None, 0), (401, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df, df.select("doc_id", "toxic").where("doc_id < 300"))
    got = toxicity.scored(df, model).where("doc_id >= 300").collect()
    assert all(r.predicted == (r.toxic or 0) for r in got) and all(0 <= r.score <= 1 for r in got)
    empty = toxicity.train(df, df.select("doc_id", "toxic").limit(0))
    assert toxicity.scored(df, empty).where("score <> 0").count() == 0
    assert toxicity.scored(none, model).count() == 0


def test_decontamination(spark, docs, none):
    item = "If the farmer named Tom buys 12 apples and 7 pears and eats 12 of them how many are left for Tom"
    bench = spark.createDataFrame([(9, item), (10, "short one"), (None, None)], "item_id long, text string")
    texts = [f"x y {item.replace('Tom', 'Ann').replace('12', '5')}", item.replace("12 of", "6 of"), item.upper() + "!", "short one", "a short one here", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontamination.find_contamination(df, bench).collect()}
    assert (0, 9) in found and found[0, 9].changed_slots == 2 and (2, 9) in found and (3, 10) in found and (4, 10) not in found and (5, 9) not in found
    assert decontamination.find_contamination(df, bench, broadcast_windows=0).count() == len(found)
    assert decontamination.decontaminated(docs, bench).count() == docs.count() and decontamination.find_contamination(none, bench).count() == 0


def test_short_items_inside_longer_documents(spark):
    items = [(1, "What is the capital of France?"), (2, "short one"), (3, "42"), (4, "one two three four five six seven eight")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = ["Quiz night: what is the capital of France? Nobody in the room knew it.", "so what is the capital of Spain", "a short one here", "Short one!", "a short, long one", "7 of 42 were there", "7 of 43", "42", "What is the capital", "one two three four five six seven eight nine"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (decontamination.BROADCAST_WINDOWS, 0):
        got = decontamination.find_contamination(df, bench, broadcast_windows=most, short_items=True).collect()
        assert {(r.doc_id, r.item_id) for r in got} == {(0, 1), (1, 1), (2, 2), (3, 2), (5, 3), (7, 3), (9, 4)}
        assert all(r.windows == 1 and r.item_windows == 1 and r.occurrences == 1 for r in got)
        assert {r.doc_id: r.changed_slots for r in got if r.item_id == 1} == {0: 0, 1: 1}


def test_query_and_pipeline_find_short_items(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "What is the capital of France?")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "Quiz night: what is the capital of France? Nobody knew it.", "en", "a", 1), (2, "nothing of the kind is in this text at all", "en", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.doc_id for r in CATALOGUE.builders()["op10_decontamination"](spark, str(tmp_path)).collect()] == [1]
    assert [r.doc_id for r in corpus_pipeline.drop_contaminated(spark, df, str(tmp_path)).collect()] == [2]


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in CATALOGUE.builders()) == list(range(1, 11))


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS, name
    assert docs.agg(F.count("*")).first()[0] > 0
