"""Each training-data operator against a brute-force version, and its edge cases."""

import base64
import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("framewell.llm.queries")
P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def corpus(seed=1, n=60):
    """Documents with copies, near copies, shared passages, repeats, odd characters, nulls and empty texts."""
    rnd = random.Random(seed)
    words = ["the", "of", "and"] * 4 + ["".join(rnd.choice("abcdeéß日") for _ in range(rnd.randrange(1, 8))) for _ in range(300)]
    prose = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    shared = [prose(60), prose(40), "a" * 250, "x y " * 60]
    out = []
    for i in range(n):
        t = prose(rnd.randrange(0, 200))
        if rnd.random() < 0.5:
            t = t + "\n" + rnd.choice(shared) + "\n" + prose(rnd.randrange(40))
        out.append(t)
    out += [out[3], out[3], out[5] + " end", " ".join([*out[6].split()[:40], "changed", *out[6].split()[40:]]), "", "   ", "\n", "😀" * 60, "-+-" * 5, "one two"]
    return [(i * 3, t, "en", "s", len(t)) for i, t in enumerate(out)] + [(1000, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    rows = df.collect()
    out = {r["doc_id"]: r for r in rows}
    assert len(out) == len(rows)
    return out


def test_bpe_is_tiktoken(spark, docs, empty):
    import tiktoken

    from framewell.llm import bpe

    path = P.path("byte_bpe_50k.tiktoken")
    assert bpe.PATTERN == P.PATTERN
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(3)
    odd = [(5000 + i, "".join(rnd.choice(" '  \n\tastremvld'é1٣ 　x!😀日-<|endoftext|>") for _ in range(rnd.randrange(40))), "", "", 0) for i in range(500)]
    both = docs.unionByName(spark.createDataFrame(odd, DOCS))
    want = {r[0]: r[1] or "" for r in [*corpus(), *odd]}
    got = by_id(bpe.digests(both, path))
    assert got.keys() == want.keys()
    for k, t in want.items():
        ids = enc.encode_ordinary(t)
        assert (got[k]["n_tokens"], got[k]["ids_sha256"], got[k]["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t))
    ids = bpe.encode(docs, path)
    back = {r["doc_id"]: bytes(r["bytes"]).decode() for r in bpe.decode(ids, path).collect()}
    assert back == {r[0]: r[1] or "" for r in corpus()}
    assert bpe.digests(empty, path).count() == 0


def test_perfect_hash_is_minimal():
    from framewell.llm.bpe import PerfectHash
    from framewell.llm.common import mixed

    for n in (1, 2, 7, 5000):
        keys = mixed(np.arange(n, dtype=np.uint64))
        assert sorted(PerfectHash(keys).of(keys).tolist()) == list(range(n))


def test_chat_trees(spark):
    from framewell.llm import chat

    rows = [
        ("t", 1, None, "user", "hi # <b> \\h", 1.0), ("t", 2, 1, "assistant", "\\### Assistant: </turn> ok", 0.2), ("t", 3, 1, "assistant", "better", 0.9),
        ("t", 4, 3, "user", None, None), ("t", 5, 3, "user: x", "z", 0.9), ("u", 1, 9, "assistant", "", 0.0), ("c", 1, 2, "user", "loop", 1.0), ("c", 2, 1, "user", "loop", 1.0),
    ]
    m = spark.createDataFrame(rows, "tree_id string, message_id long, parent_id long, role string, text string, score double")
    got = {r["tree_id"]: r for r in chat.paths(m).collect()}
    assert {k: r["path"] for k, r in got.items()} == {"t": [1, 3, 5], "u": [1]}
    assert sorted((r["branch"], r["rank"]) for r in chat.paths(m, keep=9).where("tree_id = 't'").collect()) == [(2, 3), (4, 2), (5, 1)]
    out = chat.trees(m, keep=9).withColumn("back", chat.parse(chat.F.col("formatted"))).collect()
    turns = {(r["tree_id"], r["branch"]): [(x["role"], x["text"]) for x in r["back"]] for r in out}
    assert turns["t", 2] == [("user", "hi # <b> \\h"), ("assistant", "\\### Assistant: </turn> ok")]
    assert turns["t", 4][-1] == ("user", "") and turns["t", 5][-1] == ("user: x", "z")
    deep = spark.createDataFrame([("d", i, i - 1 if i else None, "user", str(i), 0.0) for i in range(70)], m.schema)
    assert [r["path"] for r in chat.paths(deep).collect()] == [list(range(70))]
    assert chat.trees(m.limit(0)).count() == 0
    # a repeated message is one of its rows, never a mixture
    twice = spark.createDataFrame([("r", 1, None, "user", "z", 0.5), ("r", 1, None, "user", "a", 0.9), ("r", 2, 1, "user", "y", 0.0)], m.schema)
    assert [x["text"] for x in chat.trees(twice).select(chat.F.explode(chat.parse(chat.F.col("formatted"))).alias("x")).select("x.*").collect()] == ["z", "y"]


def test_chat_long_thread(spark):
    """100,000 turns of one thread: as many rows, and a digest that a plain loop confirms."""
    from framewell.llm import chat

    n = 100_000
    c = spark.range(n).select(chat.F.lit(5).cast("long").alias("conv_id"), chat.F.col("id").alias("turn"), chat.F.when(chat.F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), chat.F.concat(chat.F.lit("<"), chat.F.col("id").cast("string")).alias("text"))
    (got,) = chat.digests(chat.trees(chat.as_trees(c)), "tree_id").collect()
    said = "".join(f"{('user', 'assistant')[i % 2]}\n<{i}\n" for i in range(n))
    loss = "".join(f"<{i}" for i in range(1, n, 2))
    assert (got["n_turns"], got["turns_sha256"], got["loss_chars"], got["loss_sha256"]) == (n, sha(said), len(loss), sha(loss))


def test_chat_plans_stay_small(spark):
    """Neither the depth of a thread nor the number of trees makes broadcasts or a plan that grows, which the driver would hold."""
    from framewell.llm import chat

    c = spark.range(700).select(chat.F.when(chat.F.col("id") < 600, 0).otherwise(chat.F.col("id") % 20).alias("conv_id"), chat.F.col("id").alias("turn"), chat.F.lit("user").alias("role"), chat.F.col("id").cast("string").alias("text"))
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()

    def plans():
        bus.waitUntilEmpty(30_000)
        runs = store.executionsList()
        graphs = {x.executionId(): store.planGraph(x.executionId()).allNodes() for x in map(runs.apply, range(runs.size()))}
        return {k: Counter(g.apply(i).name() for i in range(g.size())) for k, g in graphs.items()}

    before = plans()
    rows = chat.steps(chat.as_trees(c)).groupBy("tree_id").count().collect()
    assert {r["tree_id"]: r["count"] for r in rows} == {0: 605} | {i: 5 for i in range(1, 20)}
    new = [p for k, p in plans().items() if k not in before]
    assert sum(p["BroadcastExchange"] for p in new) <= 6  # of trees that leave the loop
    assert max(p["Exchange"] + p["BroadcastExchange"] for p in new) <= 12


def test_chat_parents_that_are_absent(spark):
    """A parent that no message has ends a path as a null one does, at every depth; what hangs on a cycle has none."""
    from framewell.llm import chat

    rows = [(t, i, i - 1 if i > 1 else first, "user", str(i), 1.0) for t, first, n in [("a", None, 9), ("b", 0, 9), ("c", 99, 8), ("d", 5, 6), ("e", 0, 1)] for i in range(1, n + 1)]
    rows += [(None, 1, 0, "user", "x", 0.5), (None, 2, 1, "user", "y", None), ("f", 1, 1, "user", "self", 1.0), ("g", None, None, "user", "no id", 1.0)]
    m = spark.createDataFrame(rows, "tree_id string, message_id long, parent_id long, role string, text string, score double")
    got = {r["tree_id"]: (r["path"], r["branch_score"]) for r in chat.paths(m, keep=3).collect()}
    assert got == {"a": ([*range(1, 10)], 1.0), "b": ([*range(1, 10)], 1.0), "c": ([*range(1, 9)], 1.0), "e": ([1], 1.0), None: ([1, 2], 0.25)}


def test_chat_digests_of_repeated_turns(spark):
    from framewell.llm import chat

    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", "é😀"), (2, 0, "assistant", None), (None, 0, "user", "x"), (None, None, None, None)]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["tree_id"]: r for r in chat.digests(chat.trees(chat.as_trees(c)), "tree_id").collect()}
    assert (got[1]["n_turns"], got[1]["turns_sha256"]) == (3, sha("user\na\nuser\na\nassistant\né😀\n"))
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (2, sha("é😀"))
    assert (got[2]["n_turns"], got[2]["loss_chars"]) == (1, 0)
    assert (got[None]["n_turns"], got[None]["turns_sha256"]) == (2, sha("\n\nuser\nx\n"))


def test_quality(spark, empty):
    from framewell.llm import quality

    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality.digests(d, labels)
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert quality.digests(empty, labels).count() == 0
    blank = spark.createDataFrame([(1, None, "", "", 0), (2, "", "", "", 0), (2, "", "", "", 0)], DOCS)
    scores = {r["score"] for r in quality.digests(blank, labels.limit(0)).collect()}
    assert scores == {0.5}
    model = quality.train(d, labels)
    again = quality.train(d.repartition(7), labels.repartition(3))
    assert all((a == b).all() for a, b in zip(model.tables, again.tables, strict=True))
    assert quality.score(d.withColumn("score", quality.F.lit("x")), model).count() == 1000


def plain_features(text):
    """The features again, a character and a word at a time."""
    from framewell.llm import quality

    words, data = text.split(), text.encode()
    n, total = max(len(words), 1), max(len(data), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    count = lambda chars: sum(chr(b) in chars for b in data if b < 128)
    out = {
        "log_words": math.log(1 + len(words)), "word_length": sum(len(w) for w in words) / n, "distinct_words": len(set(words)) / n, "upper_words": sum(w.isupper() for w in words) / n,
        "repeated_next": sum(words[i] == words[i + 1] for i in range(len(words) - 1)) / n, "short_words": sum(len(w) < 4 for w in words) / n,
        "digits": count("0123456789") / total, "upper_ascii": count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / total, "sentence_marks": count(".?") / n, "commas": count(",;:") / n,
        "exclamations": count("!") / n, "pipes": count("|") / n, "symbols": count("*#%&$@^~=_<>\\{}[]/+") / n, "lines_per_word": len(lines) / n,
        "distinct_lines": len(set(lines)) / max(len(lines), 1), "top_word": max((words.count(w) for w in set(words)), default=0) / n,
    }
    return [out[f] for f in quality.FEATURES]


def plain_score(m, x):
    """A row's score by look-ups in a loop."""
    z, bins = m.intercept, [sum(edge <= v for edge in cuts) for cuts, v in zip(m.cuts, x, strict=False)]
    for k, b in enumerate(bins):
        z += m.tables[k][b]
    for (i, j), t in zip(m.pairs, m.pair_tables, strict=True):
        z += t[m.coarse[i][bins[i]]][m.coarse[j][bins[j]]]
    return 1 / (1 + math.exp(-z))


def test_quality_is_a_plain_sum_of_look_ups(spark):
    from framewell.llm import quality

    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(d, labels)
    assert model.pairs and len(model.tables) == len(quality.FEATURES)
    own = d.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "| ! | X9 é\n\n a a a")], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] or "" for r in own.collect()}
    for r in quality.score(own, model).collect():
        x = plain_features(texts[r["doc_id"]])
        assert quality.measure(texts[r["doc_id"]]) == pytest.approx(x)
        assert r["score"] == pytest.approx(plain_score(model, quality.measure(texts[r["doc_id"]]))) and r["predicted"] == (r["score"] >= 0.3)
    registered = {r["doc_id"]: r["score"] for r in quality.digests(d, labels).collect()}
    assert registered == pytest.approx({k: plain_score(model, quality.measure(texts[k])) for k in registered})


def test_top_word_is_the_commonest():
    from framewell.llm import quality

    at = quality.FEATURES.index("top_word")
    got = [quality.measure(t)[at] for t in ("spam " * 10 + "odd" + " spam" * 10, "a b a c d", "the x", "", " ")]
    assert got == [20 / 21, 2 / 5, 1 / 2, 0, 0]


def test_quality_learns_a_pair():
    from framewell.llm import quality

    rnd = np.random.default_rng(0)
    x = rnd.uniform(size=(4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((quality.fit(x, y).scores(x) > 0.5) == (y > 0.5)).mean() > 0.95


def brute_bm25(items, passage, k1=1.2, b=0.75):
    words = {i: re.findall(r"[^\W_]+", t.lower()) for i, t in items.items()}
    df = Counter(w for ws in words.values() for w in set(ws))
    mean = sum(map(len, words.values())) / len(items)
    idf = lambda w: np.log1p((len(items) - df[w] + 0.5) / (df[w] + 0.5))

    def score(ws, q):
        return sum(idf(w) * n * (k1 + 1) / (n + k1 * (1 - b + b * len(ws) / mean)) for w, n in Counter(ws).items() if w in q)

    return {i: score(ws, set(passage)) / score(ws, set(ws)) for i, ws in words.items() if ws}


def test_wand_is_bm25(spark):
    from framewell.llm import decontaminate as d

    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    items = {i: " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(3, 20))) + "? " + rnd.choice(vocab) for i in range(150)}
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    (shard,) = d.shards(b)
    (index,) = shard.classes
    for _ in range(200):
        q = [rnd.choice(vocab) for _ in range(rnd.randrange(1, 25))]
        terms = np.unique(np.searchsorted(index.terms, d._hashed([" ".join(q)])[0]))
        got = {index.ids[i]: s * d.RETRIEVE for i, s in index.search(terms.tolist())}
        want = {i: s for i, s in brute_bm25(items, q).items() if s >= d.RETRIEVE}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_decontamination(spark, empty):
    from framewell.llm import decontaminate as d

    b = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in b.collect()}
    base = [(i, t, "", "", 0) for i, t in enumerate(["lorem ipsum " * 200, None, "", "filler words " * 300 + items[3].upper() + " tail" * 500, items[5][: len(items[5]) // 5], items[7], items[7]])]
    docs = spark.createDataFrame(base, DOCS)
    got = {(r["doc_id"], r["item_id"]) for r in d.hits(docs, b).collect()}
    assert got == {(3, 3), (5, 7), (6, 7)}
    assert sorted(r["doc_id"] for r in d.clean(docs, b).collect()) == [0, 1, 2, 4]
    old = d.SHARD_BYTES
    try:
        d.SHARD_BYTES = 1000
        assert {(r["doc_id"], r["item_id"]) for r in d.hits(docs, b).collect()} == got
    finally:
        d.SHARD_BYTES = old
    assert d.hits(empty, b).count() == 0 and d.hits(docs, b.limit(0)).count() == 0
    assert d.question_and_answer("Q: why? \nAnswer: so") == ("Q: why? \n", " so")
    assert d.question_and_answer("One two. Three.") == ("One two. ", "Three.")


def brute_hits(rows, items):
    """Every passage of every document against every item, by plain loops: (doc_id, item_id) -> score."""
    from framewell.llm.decontaminate import question_and_answer

    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())

    def share(part, passage):
        n = max(1, min(5, len(part)))
        grams = {tuple(part[k : k + n]) for k in range(len(part) - n + 1)} if part else set()
        own = {tuple(passage[k : k + n]) for k in range(len(passage) - n + 1)}
        return len(grams & own) / len(grams) if grams else 1.0

    out = {}
    for i, t in rows:
        words = cut(t)
        for size in (64 << k for k in range(8)):
            own = {j: x for j, x in items.items() if len(cut(x)) <= size and (size == 64 or len(cut(x)) > size // 2)}
            for at in range(0, max(len(words) - size, 1), size) if own else ():
                passage = words[at : at + 2 * size]
                for j, s in brute_bm25(items, passage).items():
                    if j in own and s >= 0.5 and all(share(cut(p), passage) >= 0.5 for p in question_and_answer(items[j])):
                        out[i, j] = max(s, out.get((i, j), 0))
    return out


def test_decontamination_is_brute_force_in_any_shards(spark, monkeypatch):
    """Items of very different lengths, whole and in part; the same whatever else is in a shard."""
    from framewell.llm import decontaminate as d

    rnd = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = {i: f"{prose(rnd.randrange(4, 50))}? {prose(rnd.randrange(1, 4))}." for i in range(25)} | {50: f"{prose(90)}? yes indeed", 51: f"{prose(1000)}? no never", 52: "why? so", 53: ""}
    items[7] = f"{prose(30)}? certain words"
    rows = [(i, f"{prose(rnd.randrange(200))} {items[i] if i % 3 else items[i][: len(items[i]) * 2 // 3]} {prose(rnd.randrange(200))}") for i in range(25)]
    far = items[7].split("? ")
    rows += [(100, f"{far[0]}? {prose(900)} {far[1]}"), (101, items[51]), (102, f"{prose(300)} {items[50]} {prose(30)}"), (103, None), (104, items[51][:2000]), (105, " ".join(items.values()))]
    want = brute_hits(rows, items)
    assert (100, 7) not in want and (101, 51) in want and (102, 50) in want and len(want) > 15
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([*items.items(), *items.items()], "item_id long, text string").withColumn("doc_id", d.F.lit("x"))
    for size in (8 << 20, 2000):
        monkeypatch.setattr(d, "SHARD_BYTES", size)
        got = {(r["doc_id"], r["item_id"]): r["score"] for r in d.hits(docs, b).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    kept = sorted(r["doc_id"] for r in d.clean(docs.withColumn("item_id", d.F.lit(1)), b).collect())
    assert kept == sorted(i for i, _ in rows if all(i != k for k, _ in want))


def brute_bytes(rows, length):
    first, out = {}, {}
    for i, t in sorted((r[0], r[1] or "") for r in rows):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if first.setdefault(b[k : k + length], (i, k)) != (i, k):
                gone[k : k + length] = True
        edges = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[i] = (len(b), int(gone.sum()), edges, sha(bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("bucket", [20_000, 15])
def test_suffix_dedup(spark, docs, empty, bucket, monkeypatch):
    from framewell.llm import suffixes

    monkeypatch.setattr(suffixes, "BUCKET", bucket)
    got = {k: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for k, r in by_id(suffixes.digests(docs.withColumn("from", docs["lang"]), 100)).items()}
    assert got == brute_bytes(corpus(), 100)
    assert suffixes.digests(empty).count() == 0


@pytest.mark.parametrize("bucket", [20_000, 15])
def test_suffix_dedup_with_common_seeds(spark, bucket, monkeypatch):
    from framewell.llm import suffixes

    monkeypatch.setattr(suffixes, "BUCKET", bucket)
    rnd = random.Random(9)
    line = " ".join(f"common{i}" for i in range(12))
    rows = [(i, "".join(rnd.choice("ab ") for _ in range(rnd.randrange(150))) + line[: rnd.randrange(30, len(line))] + "".join(rnd.choice("ab ") for _ in range(rnd.randrange(120))), "", "", 0) for i in range(150)]
    got = {k: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for k, r in by_id(suffixes.digests(spark.createDataFrame(rows, DOCS), 100)).items()}
    assert got == brute_bytes(rows, 100)


def test_kept_text_keeps_characters():
    from framewell.llm.suffixes import kept_text

    assert kept_text("aéb", [{"from": 2, "to": 4}]) == "aé"
    assert kept_text("aéb", [{"from": 0, "to": 2}]) == "éb"


def brute_phrases(rows, length):
    words = {r[0]: re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows}
    places = defaultdict(list)
    for i, w in words.items():
        for k in range(len(w) - length + 1):
            places[tuple(w[k : k + length])].append((i, k))
    out = {}
    for i, w in words.items():
        gone = np.zeros(len(w), bool)
        for p in places.values():
            if len(p) > 1:
                for j, k in p:
                    if j == i:
                        gone[k : k + length] = True
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i] = (len(w), int(gone.sum()), sha(" ".join(kept)))
    return out


@pytest.mark.parametrize(("many", "batch"), [(2000, 40_000), (1, 5)])
def test_phrase_dedup(docs, empty, many, batch, monkeypatch):
    from framewell.llm import phrases

    monkeypatch.setattr(phrases, "MANY", many)
    monkeypatch.setattr(phrases, "BATCH", batch)
    got = {k: (r["n_words"], r["n_removed"], r["kept_sha256"]) for k, r in by_id(phrases.digests(docs, 35)).items()}
    assert got == brute_phrases(corpus(), 35)
    assert phrases.digests(empty).count() == 0


def brute_runs(segments, length):
    windows = [[tuple(w[i : i + length]) for i in range(len(w) - length + 1)] for w, _ in segments]
    copies = Counter()
    for ws, (_, n) in zip(windows, segments, strict=True):
        for w in ws:
            copies[w] += n
    out = []
    for ws in windows:
        again = [False, *(copies[w] > 1 for w in ws), False]
        edges = [i for i in range(len(ws) + 1) if again[i] != again[i + 1]]
        out.append(list(zip(edges[::2], edges[1::2], strict=True)))
    return out


def test_phrase_automaton_takes_runs_of_windows(monkeypatch):
    """The automaton gets each run of recurring windows once, not a phrase a window, and finds the same."""
    import ahocorasick

    from framewell.llm import phrases

    added, make = [], ahocorasick.Automaton

    class Recorder:
        def __init__(self):
            self.own = make()

        def __len__(self):
            return len(self.own)

        def add_word(self, word, value):
            added.append(word)
            return self.own.add_word(word, value)

        def __getattr__(self, name):
            return getattr(self.own, name)

    monkeypatch.setattr(ahocorasick, "Automaton", Recorder)
    rng = np.random.default_rng(6)
    for k in range(600):
        length = int(rng.integers(1, 7))
        sizes = rng.integers(0, 30, rng.integers(1, 12))
        segments = [([f"w{x}" for x in rng.integers(0, 1 + k % 5, n)], int(rng.integers(1, 4)) if k % 3 == 0 else 1) for n in sizes]
        assert phrases.locate(segments, length) == brute_runs(segments, length)
    base = [f"b{i}" for i in range(58)]
    segments = [(base, 2), ([*base[:50], "x"], 1), (["y", *base[10:46], "z"], 1), ([f"c{i}" for i in range(58)], 1)]
    added.clear()
    assert phrases.locate(segments, 35) == brute_runs(segments, 35) == [[(0, 24)], [(0, 16)], [(1, 3)], []]
    assert sorted(map(len, added)) == [36, 50, 58]


def brute_jaccard(rows):
    sets = {}
    for r in rows:
        w = (r[1] or "").split()
        sets[r[0]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else ("empty", r[1] or "")
    links = defaultdict(set)
    for a, x in sets.items():
        for b, y in sets.items():
            if a != b and (x == y if isinstance(x, tuple) or isinstance(y, tuple) else 9 * len(x & y) >= 4 * (len(x) + len(y))):
                links[a].add(b)
    out = {}
    for a in sets:
        seen, stack = {a}, [a]
        while stack:
            for b in links[stack.pop()] - seen:
                seen.add(b)
                stack.append(b)
        out[a] = (min(seen), len(links[a]))
    return out


@pytest.mark.parametrize("block", [512, 3])
def test_jaccard_join(spark, docs, empty, block, monkeypatch):
    from framewell.llm import jaccard

    monkeypatch.setattr(jaccard, "BLOCK", block)
    base = " ".join(f"w{i}" for i in range(300)).split()
    near = [(2000 + i, " ".join([*base[: i * 7], f"x{i}", *base[i * 7 + 1 :]]), "", "", 0) for i in range(20)]
    rows = [*corpus(), *near]
    got = {k: (r["class_id"], r["n_links"]) for k, r in by_id(jaccard.join(docs.unionByName(spark.createDataFrame(near, DOCS)))).items()}
    assert got == brute_jaccard(rows)
    assert jaccard.join(empty).count() == 0
    twice = docs.unionByName(docs)
    assert {k: (r["class_id"], r["n_links"]) for k, r in by_id(jaccard.join(twice)).items()} == brute_jaccard(corpus())


@pytest.mark.parametrize("block", [512, 24])
def test_jaccard_join_of_a_chain(spark, block, monkeypatch):
    """One group whose texts grow from 40 to 500 words, so that it has many size classes."""
    from framewell.llm import jaccard

    monkeypatch.setattr(jaccard, "BLOCK", block)
    words = [f"w{i}" for i in range(500)]
    rows = [(n, " ".join(words[:n]), "", "", 0) for n in range(40, 501, 2)] + [(1000 + n, " ".join([*words[:n], "odd"]), "", "", 0) for n in range(40, 500, 17)]
    got = {k: (r["class_id"], r["n_links"]) for k, r in by_id(jaccard.join(spark.createDataFrame(rows, DOCS))).items()}
    assert got == brute_jaccard(rows)


def test_banding():
    from framewell.llm.jaccard import banding

    bands, rows = banding(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999


def test_elias_fano():
    from framewell.llm.tokenfile import EliasFano

    rnd = np.random.default_rng(1)
    for v in ([], [0], [0, 0, 0], [5, 5, 1 << 40], np.cumsum(rnd.integers(0, 900, 3000)).tolist()):
        v = np.array(v, np.int64)
        ef = EliasFano.of(v)
        assert ef.all().tolist() == v.tolist()
        assert [ef.select(i) for i in range(len(v))] == v.tolist()
    assert sum(map(len, ef.arrays())) * 8 < len(v) * (2 + np.log2(v[-1] / len(v)) + 1.5)


def test_token_files(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    from framewell.llm import tokenfile

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    odd = [(3001, "Don't\x1cstop İSTANBUL ΣΑΣ <|endoftext|>x  é é 1²\x85", "", "", 0)]
    tokenfile.write(docs.unionByName(spark.createDataFrame(odd, DOCS)), str(tmp_path / "t"), path, 2)
    got, start = by_id(tokenfile.offsets(spark, str(tmp_path / "t"))), 0
    for i, t, *_ in sorted([*corpus(), *odd], key=lambda r: r[0]):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert tuple(got[i]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    tokenfile.write(docs.select(tokenfile.F.when(docs.doc_id > 9, docs.doc_id).alias("doc_id"), "text"), str(tmp_path / "n"), path, 2)
    back = tokenfile.offsets(spark, str(tmp_path / "n")).orderBy("start").collect()
    assert [r["doc_id"] for r in back] == [None] * 4 + sorted(i for i, *_ in corpus() if i > 9) and back[-1]["start"] + back[-1]["n_tokens"] == sum(r["n_tokens"] for r in back)
    tokenfile.write(empty, str(tmp_path / "e"), path, 2)
    assert tokenfile.offsets(spark, str(tmp_path / "e")).count() == 0


def test_words_encode_as_the_library_does(monkeypatch):
    """Strings of characters that splitting and lower-casing treat in different ways, against the library."""
    from framewell.llm import tokenfile

    raw = open(P.path("word_bpe_49k.json"), "rb").read()
    enc, rnd = tokenfile.WordEncoder(raw, 2), random.Random(11)
    odd = "İ\u095c\u09dc\ufb1d\u0307\u0301\u0345ßΣσςǅΩⓐªº²①٣日本\uac00\u1100\u1161\u11a8\U00031350\U00010d4a\u2126\u212a\u00b5_'’-…#<|>\U0001f600"
    pick = lambda: rnd.choice([odd, "abcXYZ", ",.;:!?", string.punctuation, " \n\x85\u2003\x1c", "'s't", "<|endoftext|>" if rnd.random() < 0.05 else "e"])
    texts = ["".join(rnd.choice(pick()) for _ in range(rnd.randrange(1, 30))) for _ in range(4000)] + ["GAZİ, İ.İ. x<|endoftext|>, <|startoftext|>.", ""]
    want = [np.array(e.ids, enc.kind).tobytes() for e in enc.tok.encode_batch(texts, add_special_tokens=False)]
    assert enc.by_word and enc.by_mark
    for _ in range(2):  # with an empty memo and a full one
        assert enc.encode(texts) == want
    monkeypatch.setattr(tokenfile, "MEMO", 100)  # the memo starts anew again and again
    again = tokenfile.WordEncoder(raw, 2)
    assert [again.encode([t])[0] for t in texts[:500]] == want[:500]


def test_a_worker_keeps_its_encoder(spark, docs, tmp_path):
    """What a task has learned is there for the next one in its worker."""
    from framewell.llm import tokenfile

    tokenfile.write(docs, str(tmp_path / "k"), P.path("word_bpe_49k.json"), 2)

    def step(batches):
        import pyarrow as pa
        from framewell.llm import tokenfile as t

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(e.memo) for e in t._encoders.values())], pa.int64())], ["n"])

    assert max(r["n"] for r in spark.range(0, 4, 1, 4).mapInArrow(step, "n long").collect()) > 0


def test_blocks_of_any_ids():
    """The least and the greatest id of all, repeated ids, and none."""
    from framewell.llm import tokenfile as t

    low, high = -(1 << 63), (1 << 63) - 1
    for names in ([low], [low, low, -1, 0, high], [high], [5, 5]):
        ids = np.arange(len(names), dtype="<u2")
        block = t.Block(t.pack(np.array(names, np.int64), np.ones(len(names), np.int64), ids.tobytes(), 2, 0))
        assert block.doc_ids().to_pylist() == names
        assert (block.names.all() + np.int64(names[0]).view(np.uint64)).view(np.int64).tolist() == names
    assert t.Block(t.pack(None, np.ones(3, np.int64), ids.tobytes(), 2, 0)).doc_ids().to_pylist() == [None] * 3


def test_letters_that_become_marks():
    """Letters that the normalizer takes apart stay with the punctuation after them."""
    from framewell.llm import tokenfile

    raw = open(P.path("word_bpe_49k.json"), "rb").read()
    enc = tokenfile.WordEncoder(raw, 2)
    assert enc.by_word and enc.by_mark
    words = [w + c + t + m for c in "\u0130\u095c\u09dc\u0a33\ufb1d\ufb4e\u00c9" for w in ("", "GAZ", "\u091c", "ab\u0130") for t in ("", "a") for m in ("", *enc.MARKS, "?!", "...")]
    want = [np.array(enc.tok.encode(w, add_special_tokens=False).ids, enc.kind).tobytes() for w in words]
    assert enc.encode(words) == want
    assert enc.encode([" ".join(words)]) == [b"".join(want)]


def test_blocks_are_read_by_select():
    """Spans and doc ids of a block read back come through its select samples: damaged ones do not go unseen."""
    from framewell.llm import tokenfile as t

    rnd = np.random.default_rng(2)
    n = 3 * t.SAMPLE + 5
    counts, names = rnd.integers(1, 40, n), np.cumsum(rnd.integers(0, 2000, n)) - 5000
    ids = rnd.integers(0, 49_000, int(counts.sum())).astype("<u2")
    ends = np.cumsum(counts)
    data = t.pack(names, counts, ids.tobytes(), 2, 0)
    got = t.spans(t.Block(data), 70).to_pydict()
    assert got["doc_id"] == names.tolist() and got["start"] == (ends - counts + 70).tolist() and got["n_tokens"] == counts.tolist()
    assert got["ids_crc32"] == [zlib.crc32(ids[e - c : e].astype("<u4")) for c, e in zip(counts, ends, strict=True)]
    sizes = t.HEADER.unpack_from(data)[-6:]
    for list_at, column in ((2, "n_tokens"), (5, "doc_id")):
        at = t.HEADER.size + sum(sizes[:list_at])
        bad = data[: at + 4] + bytes(sizes[list_at] - 4) + data[at + sizes[list_at] :]
        assert t.spans(t.Block(bad), 70).to_pydict()[column] != got[column]


def test_spotsigs(spark, docs, empty):
    from framewell.llm import spotsigs

    rows = {r[0]: r[1] or "" for r in corpus()}
    got = by_id(spotsigs.digests(docs))
    ids = sorted(rows, reverse=True)
    by_text = {}
    for a, b in zip(ids, [*ids[1:], ids[0]], strict=True):
        t, n, r = rows[a], len(rows[a]), got[a]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha(t[: n - n // 3] + rows[b][: n // 3]))
        f, g = ({x[i : i + 8] for i in range(0, len(x), 8)} for x in (r["fingerprint"], got[b]["fingerprint"]))
        assert r["near_next"] == pytest.approx(len(f & g) / len(f | g) if f | g else 1.0)
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]
    assert spotsigs.digests(empty).count() == 0
    long = spark.createDataFrame([(1, "the " * 50_000, "", "", 0), (2, "word " * 50_000 + "!" * 90_000, "", "", 0)], DOCS)
    assert spotsigs.digests(long).where("near_next < 0.5").count() == 2
    one = spotsigs.digests(docs.where("doc_id = 9")).first()
    assert one["near_next"] == 1.0


def plain_spots(text):
    """The signatures of a text, word by word."""
    import xxhash
    from framewell.llm.spotsigs import CHAIN, COMMON, STRETCH

    def hashed(*parts):
        seed = 42
        for p in parts:
            seed = xxhash.xxh64_intdigest(p.encode(), seed)
        return seed & 0xFFFFFFFF

    common = set(COMMON.split())
    words = "".join(c if c.isalpha() or c.isdigit() else " " for c in text.lower()).split()
    spots = [("", [])]  # (anchor, content words)
    for i, w in enumerate(words):
        anchor, content = spots[-1]
        if w in common:
            if anchor and not content and anchor.count(" ") < 8:
                spots[-1] = (f"{anchor} {w}", content)
            else:
                spots.append((f" {w}", []))
        else:
            content.append(w)
            if len(content) == STRETCH and (i + 1 == len(words) or words[i + 1] not in common):
                spots.append(("", []))
    out = set()
    for (anchor, content), (_, after) in zip(spots, [*spots[1:], ("", [])], strict=True):
        if chain := (content + after)[:CHAIN]:
            out.add(hashed(anchor, " ".join(chain)))
    return out or ({hashed(text)} if text else set())


def test_spotsigs_signatures_word_by_word(spark, docs):
    from framewell.llm import spotsigs

    own = docs.unionByName(spark.createDataFrame([(2000, "the " * 30 + "end of it", "", "", 0), (2001, " ".join(f"w{i}" for i in range(40)) + " the", "", "", 0), (2002, "Le chat, et le chien; ÉTÉ 42!", "", "", 0)], DOCS))
    rows = {r["doc_id"]: r["text"] or "" for r in own.collect()}
    ids = sorted(rows, reverse=True)
    show = lambda s: "".join(f"{x:08x}" for x in sorted(s))
    near = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    got = by_id(spotsigs.digests(own))
    for a, b in zip(ids, [*ids[1:], ids[0]], strict=True):
        t, cut = rows[a], len(rows[a]) // 3
        mine, edited = plain_spots(t), plain_spots(t[: len(t) - cut] + rows[b][:cut])
        assert (got[a]["fingerprint"], got[a]["edited_fingerprint"]) == (show(mine), show(edited))
        assert (got[a]["near_edited"], got[a]["near_next"]) == pytest.approx((near(mine, edited), near(mine, plain_spots(rows[b]))))


def test_spotsigs_near_pairs(spark):
    from framewell.llm import spotsigs

    base = " ".join(f"the w{i} x{i} of y{i} z{i}" for i in range(60))
    rows = [(1, base), (2, base + " the new end"), (3, base.replace("w30", "q")), (4, "the quite different text of all"), (5, base), (6, ""), (7, None)]
    got = {(r["a"], r["b"]) for r in spotsigs.near_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 2), (1, 3), (2, 3)}


def test_sharding(spark, docs, empty):
    from framewell.llm import sharding

    rows = {r[0]: (r[1] or "").encode() for r in corpus()}
    out = sharding.shard(docs.unionByName(docs)).collect()
    assert len(out) == 2 * len(rows)
    slots = defaultdict(list)
    for r in out:
        assert (r["size"], r["text_crc32"], r["law"]) == (len(rows[r["doc_id"]]) + 1, zlib.crc32(rows[r["doc_id"]]), "key")
        assert r["grown_shard"] in (r["shard"], 8)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(empty).count() == 0
    for r in out:  # owners again, by a plain loop
        draws = [-1 / math.log((int(hashlib.md5(f"{r['doc_id']}\x1fshard-{k}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) for k in range(9)]
        assert r["shard"] == draws.index(max(draws[:8])) and r["grown_shard"] == draws.index(max(draws))
    copies = sharding.shard(spark.range(200_000).select(sharding.F.lit(3).alias("doc_id"), sharding.F.lit("x").alias("text")))
    assert copies.agg(sharding.F.count("*"), sharding.F.countDistinct("slot"), sharding.F.min("slot"), sharding.F.max("slot")).first()[:] == (200_000, 200_000, 0, 199_999)
    many = spark.range(40_000).withColumnRenamed("id", "doc_id").withColumn("text", sharding.F.lit(""))
    share = {r["shard"]: r["count"] for r in sharding.shard(many, 2, weights=[1, 3]).groupBy("shard").count().collect()}
    assert abs(share[1] / 40_000 - 0.75) < 0.01
    grown = {r["grown_shard"]: r["count"] for r in sharding.shard(many, 4).groupBy("grown_shard").count().collect()}
    assert abs(grown[4] / 40_000 - 0.2) < 0.01


def test_nulls_everywhere(spark):
    """Rows of nulls alone, repeated, go through every operator on documents."""
    from framewell.llm import bpe, decontaminate, jaccard, phrases, quality, sharding, spotsigs, suffixes

    d = spark.createDataFrame([(None, None, None, None, None)] * 2 + [(None, "a b c " * 60, "", "", 0)] * 2 + [(1, "a b c " * 60, "", "", 0)] * 2, DOCS)
    b = spark.createDataFrame([(None, None), (1, None), (None, "a")], "item_id long, text string")
    assert bpe.digests(d, P.path("byte_bpe_50k.tiktoken")).count() == 6
    assert quality.digests(d, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")).count() == 6
    assert decontaminate.clean(d, b).count() == 6 - decontaminate.hits(d, b).select("doc_id").count()
    got = suffixes.digests(d).collect()
    assert len(got) == 6 and {r["n_removed"] for r in got if r["doc_id"] is None} == {0} and {r["n_removed"] for r in got if r["doc_id"] == 1} == {354}
    assert phrases.digests(d).count() == 6
    assert [tuple(r) for r in jaccard.join(d).collect()] == [(1, 1, 0)]
    assert sharding.shard(d).count() == 6 and spotsigs.digests(d).count() == 6


def test_pipeline(spark):
    import corpus_pipeline as p

    out = p.run(spark, SF)
    docs, ids = spark.read.parquet(f"{SF}/documents.parquet"), [r["doc_id"] for r in out.collect()]
    assert len(ids) == len(set(ids)) and 0 < len(ids) < docs.count()
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "x", "", "", 1), (3, "", "", "", 0)]
    for table in (spark.createDataFrame([], DOCS), spark.createDataFrame(rows, DOCS)):
        for name, stage in p.STAGES:
            table = stage(spark, table, SF)
            if name != p.STAGES[-1][0]:
                assert table.columns == docs.columns
        assert table.count() in (0, 2)  # null and empty texts are equal


def test_pipeline_judges_each_text_of_an_id(spark):
    import corpus_pipeline as p

    prose = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    a, b, c = prose("a", 80), prose("b", 80), prose("c", 80)
    near = [f"{a} end{i}" for i in range(3)]
    rows = [(1, a, "en", "s", 0), (1, b, "en", "s", 0), (1, b, "en", "r", 0), (2, c, "en", "s", 0), (3, None, "en", "s", 0), (None, a, "en", "s", 0)]
    rows += [(5, t, "en", "s", 0) for t in (*near, prose("d", 80), prose("e", 80), b)] + [(6, "", "en", "s", 0), (6, prose("f", 80), "en", "s", 0)]
    got = p.ngram_jaccard(spark, spark.createDataFrame(rows, DOCS).repartition(3), SF)
    assert got.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    want = [(1, a, "s"), (1, b, "r"), (2, c, "s"), (3, None, "s"), (None, a, "s"), (5, prose("d", 80), "s"), (5, prose("e", 80), "s"), (6, prose("f", 80), "s")]
    assert sorted(map(str, ((r["doc_id"], r["text"], r["source"]) for r in got.collect()))) == sorted(map(str, want))

    passage = prose("shared", 30)
    rows = [(1, "one " + passage, "en", "s", 0), (2, prose("x", 60), "en", "s", 0), (2, passage + prose(" y", 60), "en", "s", 0), (2, passage + prose(" y", 60), "en", "s", 0)]
    got = p.suffix_dedup(spark, spark.createDataFrame(rows, DOCS), SF).collect()
    left = [(1, "one " + passage), (2, prose("x", 60)), *[(2, prose(" y", 60).strip())] * 2]
    assert sorted((r["doc_id"], r["text"].strip()) for r in got) == sorted(left) and all(r["n_chars"] == len(r["text"]) for r in got)


def thue_morse(n):
    """Two complementary words of 2^n letters."""
    w = "a"
    for _ in range(n):
        w += w.translate(str.maketrans("ab", "ba"))
    return w, w.translate(str.maketrans("ab", "ba"))


def test_hashes_tell_thue_morse_words_apart():
    from framewell.llm.common import _PRIME, SliceHash, gram_hashes, times

    a, b = (np.frombuffer(x.encode(), np.uint8) for x in thue_morse(12))
    both = np.concatenate([a, b])
    h = SliceHash(both)
    n = len(a)
    x, y = h.of(np.array([0, 0]), np.array([n, n // 2])), h.of(np.array([n, n]), np.array([2 * n, n + n // 2]))
    assert (x != y).all() and (SliceHash(a).of(np.array([0]), np.array([n])) == x[0]).all()
    wide = SliceHash(both.astype(np.uint64) * np.uint64(0xABCDEF0123456789))
    assert wide.of(np.array([0]), np.array([n])) != wide.of(np.array([n]), np.array([2 * n]))
    rnd = random.Random(4)
    p, q = [rnd.randrange(_PRIME) for _ in range(500)], [rnd.randrange(_PRIME) for _ in range(500)]
    assert times(np.array(p, np.uint64), np.array(q, np.uint64)).tolist() == [i * j % _PRIME for i, j in zip(p, q, strict=True)]
    units = np.frombuffer(b"abcabcabcabcabcabcabcabcabcabcabcab" * 3, np.uint8)
    for size in (1, 3, 8, 12, 32):
        for u in (units, units.astype(np.uint64)):
            g = gram_hashes(u, size)
            words = [bytes(units[i : i + size]) for i in range(len(units) - size + 1)]
            assert len(g) == len(words) and len(set(g.tolist())) == len(set(words))


def test_words_that_only_a_weak_hash_takes_for_equal(spark):
    from framewell.llm import jaccard, phrases

    a, b = thue_morse(10)
    tail = [f"w{i}" for i in range(44)]
    rows = [(1, " ".join([a, *tail[:22], a, *tail[22:]]), "", "", 0), (2, " ".join([b, *tail[:22], b, *tail[22:]]), "", "", 0)]
    d = spark.createDataFrame(rows, DOCS)
    assert {k: (r["n_words"], r["n_removed"], r["kept_sha256"]) for k, r in by_id(phrases.digests(d)).items()} == brute_phrases(rows, 35)
    assert {k: (r["class_id"], r["n_links"]) for k, r in by_id(jaccard.join(d)).items()} == brute_jaccard(rows)


def test_one_seed_many_times_in_one_document(spark):
    """A line repeated 10^5 times in a document, and a passage shared with another."""
    from framewell.llm import phrases, suffixes

    line = "the same line over and over again, twelve words of it\n"
    odd = " ".join(f"odd{i}" for i in range(40))
    rows = [(1, line * 100_000 + odd, "", "", 0), (2, "begin " + odd + " end", "", "", 0), (3, "nothing", "", "", 0)]
    d = spark.createDataFrame(rows, DOCS)
    got = by_id(suffixes.digests(d))
    period, m = len(line), len(line) * 100_000
    assert (got[1]["n_removed"], got[1]["n_spans"]) == (m - period, 1) and got[1]["kept_sha256"] == sha(line + odd)
    assert got[2]["kept_sha256"] == sha("begin  end") and got[2]["n_removed"] == len(odd)
    assert got[3]["n_removed"] == 0
    words = by_id(phrases.digests(d))
    assert {k: (r["n_words"], r["n_removed"]) for k, r in words.items()} == {1: (11 * 100_000 + 40, 11 * 100_000 + 40), 2: (42, 40), 3: (1, 0)}


def test_texts_of_one_id_are_judged_apart(spark):
    from framewell.llm import phrases, suffixes

    prose = " ".join(f"p{i}" for i in range(90))
    rows = [(1, "short text of 25 letters.", "", "", 0), (1, prose + " a", "", "", 0), (2, prose + " b", "", "", 0), (2, "another", "", "", 0), (2, "another", "", "", 0)]
    d = spark.createDataFrame(rows, DOCS)
    left = {r["kept_sha256"]: r["n_removed"] for r in suffixes.digests(d).collect()}
    assert left[sha("short text of 25 letters.")] == 0 and left[sha(prose + " a")] == 0 and left[sha("b")] == len(prose) + 1 and left[sha("another")] == 0
    words = sorted((r["n_words"], r["n_removed"]) for r in phrases.digests(d).collect())
    assert words == [(1, 0), (1, 0), (5, 0), (91, 90), (91, 90)]
