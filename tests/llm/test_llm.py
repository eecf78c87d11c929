"""The ten operators on small tables: brute force, round trips, held-out accuracy, and odd inputs."""

import hashlib
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from veilscope.llm import chatquotes, exactdedup, htmltext, media, mixing, neardedup, packing, quality, tokenfile, tokens, toxicity  # noqa: E402
from veilscope.llm.shared import numbered  # noqa: E402

SMALL = "/root/testdata/sf0.001"
#: Names that the operators use themselves.
CLASHING = ["row", "key", "size", "digest", "_row", "_size", "_part", "_nll", "_chars", "_limit", "_own", "_kept", "_metadata", "_row_index", "_file_path", "hash", "taken", "node", "class", "piece", "start", "block"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASHING)


def documents(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    full = [(i, t, lang, s, len(t or ""), *range(len(CLASHING))) for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3) if full else spark.createDataFrame([], SCHEMA)


ODD = [(1, None, "en", "a"), (2, "", None, None), (3, "x", "en", "b"), (4, "  \t\n", "de", ""), (None, "x y", "en", "a"), (5, "word " * 30_000, "en", "a"), (3, "x", "en", "b"), (6, "é 日本 \U0001f600 \x00 z", "fr", "b"), (7, "a x  y", "en", None)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "t")
    documents(spark, ODD).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


# --- 1: quotation linking -------------------------------------------------------------------------------------------


def talk(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_quotes_link_to_their_originals(spark):
    rows = [
        (1, 0, "a", "Hello there everyone. How does the engine start up?\nSecond line of the text here."),
        (1, 1, "b", "> Hello there everyone. How does\n> the engine start up?\nYou turn the big key."),
        (1, 2, "a", "On Monday, Ann wrote:\n> > Hello there everyone. How does the engine start up?\n> You turn the big key.\nThanks a lot for that!"),
        (1, 3, "c", "Unrelated message number four"),
        (1, 4, "b", ">> You turn the big key.\n> Thanks a lot for that!\n\nwelcome"),
        (2, 0, "a", "> You turn the big key.\nnever said here"),
    ]
    out = {(r["conv_id"], r["turn"]): r for r in chatquotes.threaded(talk(spark, rows)).collect()}
    assert [out[1, t]["reply_to"] for t in range(5)] == [None, 0, 1, None, 2]
    assert [out[1, t]["position"] for t in range(5)] == [0, 1, 2, 4, 3]
    assert [out[1, t]["depth"] for t in range(5)] == [0, 1, 2, 0, 3]
    assert out[1, 2]["body"] == "Thanks a lot for that!" and out[1, 2]["linked"] == 2 and out[1, 4]["body"] == "welcome"
    assert out[2, 0]["reply_to"] is None and out[2, 0]["quotes"] == 1 and out[2, 0]["linked"] == 0
    chat = chatquotes.formatted(chatquotes.threaded(talk(spark, rows))).where("conv_id = 2").first()["chat"]
    assert chat == "<|a|>\nnever said here\n<|end|>\n"


def test_short_messages_quoted_whole_are_linked(spark):
    rows = [(1, 0, "a", "Lunch?"), (1, 1, "b", "ok, Friday?"), (1, 2, "c", "> Lunch?\nno"), (1, 3, "a", "> ok, Friday?\nfine"), (1, 4, "b", "> ...\n??"), (2, 0, "a", "好的。"), (2, 1, "b", "> 好的。\n谢谢")]
    out = {(r["conv_id"], r["turn"]): r["reply_to"] for r in chatquotes.threaded(talk(spark, rows)).collect()}
    assert out == {(1, 0): None, (1, 1): None, (1, 2): 0, (1, 3): 1, (1, 4): None, (2, 0): None, (2, 1): 0}


def test_quotes_in_odd_conversations(spark):
    rows = [(None, 0, "u", None), (None, 0, "u", None), (1, None, "u", "> Thanks a lot for that!"), (1, 0, None, "Thanks a lot for that!"), (1, 1, "u", "> " + "far too long " * 5000), (1, 2, "u", "")]
    out = chatquotes.threaded(talk(spark, rows)).collect()
    assert sum(r["copies"] for r in out) == 6 and len(out) == 5 and all(r["reply_to"] is None for r in out)
    assert chatquotes.threaded(talk(spark, rows[:1]).limit(0)).collect() == []


def test_threads_equal_sql(spark, tmp_path):
    from oracle import compare

    rows = [(1, 0, "a", "Hello there everyone. How does it start?\nSecond line of the text."), (1, 1, "b", "Bob said:\n> Hello there everyone. How does\n> it start?\nYou turn the big key."), (1, 2, "a", "> > Hello there everyone. How does it start?\n> You turn the big key.\nThanks a lot for that!"), (None, 0, "u", None), (1, None, "u", "> Thanks a lot for that!")]
    rows += [(7, t, "u", f"This is message number {t} of all.\n> This is message number {t - 1} of all.") for t in range(9)]
    talk(spark, rows).coalesce(1).toPandas().astype({"conv_id": "Int64", "turn": "Int64"}).to_parquet(tmp_path / "conversations.parquet")
    compare(spark, "op1_chatquotes", str(tmp_path))
    compare(spark, "op1_chatquotes", SMALL)


def test_a_large_quoted_table_equals_sql(spark, tmp_path):
    """Thousands of messages with quotes at several depths; most quotes are of the first message."""
    from oracle import compare

    rng, rows = np.random.default_rng(12), []
    for conv in range(40):
        said = []
        for turn in range(4 if conv else 1200):
            own = [f"{' '.join(rng.choice(['alpha', 'beta', 'gamma', 'delta'], 5))} number {turn}{rng.choice(['.', '!', '?'])}" for _ in range(int(rng.integers(1, 4)))]
            if rng.random() < 0.2:
                own = [str(rng.choice(["ok", "no way", "yes."]))]
            lines = ["On Monday, Ann wrote:"] if said and rng.random() < 0.2 else []
            for _ in range(int(rng.integers(0, 3)) if said else 0):
                quoted = said[0] if rng.random() < 0.7 else said[int(rng.integers(len(said)))]
                mark = str(rng.choice(["> ", ">> ", "> > > "]))
                lines += [mark + x for x in (quoted if rng.random() < 0.6 else quoted[:1])]
            said.append(own)
            rows.append((conv, turn, str(rng.choice(["a", "b"])), "\n".join([*lines, *own])))
    talk(spark, rows).coalesce(1).toPandas().to_parquet(tmp_path / "conversations.parquet")
    compare(spark, "op1_chatquotes", str(tmp_path))
    out = chatquotes.threaded(talk(spark, rows)).agg(F.sum("linked"), F.count("reply_to"), F.sum((F.col("reply_to") == 0).cast("int"))).first()
    assert out[0] > 900 and out[1] > 700 and out[2] > 200


def test_a_message_replies_by_its_outermost_quotes(spark):
    rows = [(1, 0, "a", "The first of all messages here"), (1, 1, "b", "And this is the second message"), (1, 2, "c", ">> The first of all messages here\nyes"), (1, 3, "c", "> > The first of all messages here\n> And this is the second message\nno")]
    out = {r["turn"]: r["reply_to"] for r in chatquotes.threaded(talk(spark, rows)).collect()}
    assert out == {0: None, 1: None, 2: 0, 3: 1}


def test_a_deep_thread_keeps_its_order(spark):
    rows = [(1, t, "u", f"This is message number {t} of all.\n" + (f"> This is message number {t - 1} of all." if t else "")) for t in range(40)]
    out = sorted(chatquotes.threaded(talk(spark, rows)).collect(), key=lambda r: r["turn"])
    assert [r["depth"] for r in out] == list(range(40)) == [r["position"] for r in out]


# --- 2: quality -----------------------------------------------------------------------------------------------------


def kneser_ney(grams_by_order, order, gram, size):
    """Interpolated modified Kneser-Ney straight from its definition; grams are tuples."""
    counts = grams_by_order[order]
    n = Counter(min(c, 5) for c in counts.values())
    if n[1] and n[2]:
        y = n[1] / (n[1] + 2 * n[2])
        d = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 0.5]
        d = [min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d, strict=True)]
    else:
        d = [0.5] * 3
    cut = lambda c: d[min(c, 3) - 1]
    below = 1 / size if order == 1 else kneser_ney(grams_by_order, order - 1, gram[1:], size)
    mates = [c for g, c in counts.items() if g[:-1] == gram[:-1]]
    if not mates:
        return below
    c = counts.get(gram, 0)
    return (c - cut(c) if c else 0) / sum(mates) + sum(map(cut, mates)) / sum(mates) * below


def units(text):
    raw = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").tolist()
    return [0xFFFF] * 3 + raw + [0xFFFF]


def test_quality_equals_the_definition(spark, tmp_path):
    trusted = ["the cat sat on the mat", "the dog sat on the cat", "a cat and a dog", "to the hat", "日本語 \U0001f600 の文", "the mat"] * 3
    others = ["the cat", "zebra hat", "dog on a mat \U0001f601", "日本の猫", "Ж", "\x00"]
    rows = [(i, t, "en" if i % 2 else "de", "s") for i, t in enumerate(trusted + others)]
    documents(spark, rows).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    labels = spark.createDataFrame([(i, 1) for i in range(len(trusted))], "doc_id long, quality int")
    fold = {r["doc_id"]: r["f"] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(4)).alias("f")).collect()}
    counted = [t for i, t in enumerate(trusted) if fold[i]]
    grams = {4: Counter(tuple(u[i : i + 4]) for u in map(units, counted) for i in range(len(u) - 3))}
    for order in (3, 2, 1):
        grams[order] = Counter(g[1:] for g in grams[order + 1])
    size = len(grams[1]) + 1

    def nll(text):
        u = units(text)
        return -np.mean([np.log(kneser_ney(grams, 4, tuple(u[i : i + 4]), size)) for i in range(len(u) - 3)])

    wanted = {i: nll(t) for i, t, *_ in rows}
    held = [np.floor((wanted[i] - 3 / np.sqrt(len(units(t)) - 3)) * 1000) for i, t, *_ in rows if i < len(trusted) and not fold[i]]
    out = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    for i, t, *_ in rows:
        n = len(units(t)) - 3
        limit = sorted(held)[int(np.ceil(0.99 * len(held))) - 1] / 1000 + 0.001 + 0.03 + 3 / np.sqrt(n)  # too few by language
        assert np.log(out[i]["perplexity"]) == pytest.approx(wanted[i], rel=1e-4)
        assert np.log(out[i]["threshold"]) == pytest.approx(limit, abs=1e-6)
        assert out[i]["kept"] == (round(wanted[i], 4) <= round(limit, 4))


def test_windows_of_a_long_text_change_nothing(monkeypatch):
    text = "日本語 \U0001f600 cat " * 50
    whole = np.concatenate(list(quality._codes(text)))
    for window in (1, 2, 3, 7, 100):
        monkeypatch.setattr(quality, "_WINDOW", window)
        assert np.array_equal(np.concatenate(list(quality._codes(text))), whole)
    assert len(whole) == len(units(text)) - 3 and not list(quality._codes(""))


def test_quality_keeps_trusted_text_and_rejects_junk(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality.classify(docs, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in out}
    assert kept[1] >= 0.97 and kept[0] <= 0.35


def test_all_trusted_documents_count(spark, tmp_path):
    rare = F.col("doc_id") % 250 == 0
    docs = spark.range(70_000).select(F.col("id").alias("doc_id")).withColumn("lang", F.when(rare, "rare").otherwise("en")).withColumn("text", F.concat(F.when(rare, "zq ").otherwise("the cat "), F.col("doc_id").cast("string")))
    labels = docs.where("doc_id < 45000").select(F.col("doc_id").cast("int").alias("doc_id"), F.lit(1).alias("quality"))
    docs.write.parquet(str(tmp_path / "t"))
    rows = numbered(spark.read.parquet(str(tmp_path / "t"))).select("row", F.col("doc_id").alias("key"), "lang", "text")
    flags = quality.BlockFiles(quality._flags(rows, labels.unionByName(labels.limit(5)).withColumnsRenamed({"doc_id": "key", "quality": "label"}), "key", "label"), "flags")
    scores = quality.scored(rows, quality.model_of(rows, flags), flags).cache()
    assert scores.where("fold >= 0").count() == 45_000 and scores.where("fold >= 0 and lang = 'rare'").count() == 180
    assert {r["lang"] for r in quality.thresholds(scores).where("not every").collect()} == {"rare", "en"}


def test_quality_of_odd_tables(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1), (None, 1), (7, 0)], "doc_id long, quality int")
    out = quality.classify(odd, labels).collect()
    assert len(out) == len(ODD) and all(not r["kept"] for r in out if r["doc_id"] in (1, 2, 4))
    assert quality.classify(empty, labels.limit(0)).collect() == []
    untrained = {r["doc_id"]: r["kept"] for r in quality.classify(odd, labels.limit(0)).collect()}
    assert untrained[3] and untrained[5] and not untrained[1]
    assert quality.keep_good(odd, labels.limit(0)).columns == odd.columns


# --- 3: mixing ------------------------------------------------------------------------------------------------------


def webster(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


@pytest.mark.parametrize("votes, seats", [([53, 24, 23], 7), ([10, 10, 10], 4), ([1000, 1, 1, 1], 10), ([5.5, 3.25, 0, 1.25] * 5, 33), ([1], 9), ([3, 2, 1], 0)])
def test_apportionment_equals_highest_quotients(spark, votes, seats):
    df = spark.createDataFrame([(1, i, float(v), seats) for i, v in enumerate(votes)], "g int, i int, v double, seats long")
    out = {r["i"]: r["quota"] for r in mixing.apportion(df, ["g"], ["i"], "v", "seats").collect()}
    assert [out[i] for i in range(len(votes))] == webster(votes, seats)


def test_seats_beyond_a_limit_go_to_others(spark):
    rng = np.random.default_rng(3)
    for _ in range(8):
        votes, seats = rng.integers(1, 200, 12).tolist(), int(rng.integers(20, 90))
        share = [v * seats / sum(votes) for v in votes]
        most = [max(0, int(np.ceil(x - rng.random()))) if rng.random() < 0.4 else int(x) + 2 for x in share]
        won = [0] * 12
        for _ in range(min(seats, sum(most))):
            best = max((i for i in range(12) if won[i] < most[i]), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
            won[best] += 1
        df = spark.createDataFrame([(1, i, float(v), seats, m) for i, (v, m) in enumerate(zip(votes, most, strict=True))], "g int, i int, v double, seats long, m long")
        out = {r["i"]: r["quota"] for r in mixing.apportion(df, ["g"], ["i"], "v", "seats", F.col("m")).collect()}
        assert [out[i] for i in range(12)] == won


def test_mix_equals_sql(spark):
    from oracle import compare

    compare(spark, "op3_mixing", SMALL)


def test_mix_and_its_documents(spark, odd, empty, tmp_path):
    rows = [(i, f"w{i} " * (1 + i % 37), "en", f"s{i % 4}") for i in range(400)]
    documents(spark, rows).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    plan = mixing.mix(docs).withColumn("source", F.concat(F.lit("s"), (F.col("doc_id") % 4).cast("string"))).collect()
    taken = defaultdict(int)
    for r in plan:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for r in plan:
        assert abs(taken[r["source"]] - r["target"]) <= 0.02 * r["target"] + 8
    out = mixing.mixed_documents(docs, count="n_chars")
    assert out.columns == docs.columns
    words = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.sum(mixing.words(F.col("text"))).alias("n")).collect()}
    assert words == {r["doc_id"]: r["taken"] for r in plan if r["taken"]}
    assert len(mixing.mix(odd).collect()) == len(ODD) and mixing.mix(empty).collect() == []
    assert mixing.mixed_documents(empty).collect() == []


# --- 4: exact dedup -------------------------------------------------------------------------------------------------


def test_cuckoo_index_inserts_deletes_and_grows():
    index = exactdedup.CuckooIndex(4)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, k in enumerate(keys):
        assert index.find(k) is None
        index.insert(k, i)
    assert index.resizes > 3 and len(index) == 3000 and all(index.find(k) == i for i, k in enumerate(keys))
    assert all(index.delete(k) for k in keys[::2]) and not index.delete(keys[0])
    assert [index.find(k) for k in keys[:4]] == [None, 1, None, 3]
    with pytest.raises(KeyError):
        index.insert(keys[1], 0)


def test_exact_dedup_equals_sql(spark):
    from oracle import compare

    compare(spark, "op4_exactdedup", SMALL)


def test_exact_dedup_of_odd_tables(odd, empty):
    out = exactdedup.dedup(odd).collect()
    assert len(out) == len(ODD) and sum(r["kept"] for r in out) == 6
    blank = [r for r in out if r["text_sha256"] == hashlib.sha256(b"").hexdigest()]
    assert {r["doc_id"] for r in blank} == {1, 2, 4} and {r["keep_id"] for r in blank} == {4} and {r["group_size"] for r in blank} == {3}
    assert exactdedup.keep_one(odd).count() == 6 and exactdedup.keep_one(odd).columns == odd.columns
    assert exactdedup.dedup(empty).collect() == []


def test_a_shard_holds_a_fixed_number_of_digests(spark, monkeypatch):
    monkeypatch.setattr(exactdedup, "LIVE_DIGESTS", 10)
    rows = spark.range(600).select(F.col("id").alias("row"), F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 150).cast("string")).alias("text")).repartition(3)
    out = exactdedup.build_index(exactdedup.digests(rows)).collect()
    assert len(out) == 150 and {(r["row"], r["size"]) for r in out} == {(i, 4) for i in range(150)}


def test_the_index_is_updated(spark):
    rows = lambda *ts: exactdedup.digests(spark.createDataFrame([(i, i, t) for i, t in enumerate(ts)], "row long, doc_id long, text string"))
    index = exactdedup.build_index(rows("a", "b", "b ", "c"))
    sizes = lambda df: sorted(r["size"] for r in df.collect())
    assert sizes(index) == [1, 1, 2]
    assert sizes(exactdedup.update_index(index, rows("b", "d"), rows("a"))) == [1, 1, 3]


# --- 5: toxicity ----------------------------------------------------------------------------------------------------


def test_toxicity_finds_unseen_misspellings():
    rng = np.random.default_rng(5)
    filler = ["".join(rng.choice(list("aeioustnrl"), rng.integers(2, 8))) for _ in range(300)]
    clean = [" ".join(rng.choice(filler, 60)) for _ in range(240)]
    toxic = [" ".join([*rng.choice(filler, 40), rng.choice(["stupid", "worthless", "pathetic"]), *rng.choice(filler, 20)]) for _ in range(80)]
    model = toxicity.fit(clean[:200] + toxic[:60], [0] * 200 + [1] * 60)
    score = lambda t: toxicity._sigmoid(toxicity.margins(t, *model))
    assert np.mean([score(t) >= 0.7 for t in toxic[60:]]) >= 0.9 and np.mean([score(t) >= 0.7 for t in clean[200:]]) <= 0.1
    assert score(clean[0] + " you stuppid " + clean[1]) > score(clean[0] + " " + clean[1])
    assert score("word " * 60_000 + "worthless pathetic") >= 0.7


def plain_margin(text, weight, bias):
    """The worst window straight from the definition: words, their n-grams with borders, means of overlapping windows."""
    import re

    mult, base, full = 0x9E3779B97F4A7C15, 1_000_003, 2**64
    words = re.findall("[a-z0-9\u00e0-\uffff]+", text.lower())
    bags = []
    for word in words:
        points = [0, *map(ord, word), 0]
        bag = []
        for size in (3, 4, 5, 6):
            for at in range(len(points) - size + 1):
                code = 0
                for x in points[at : at + size]:
                    code = (code * base + x) % full
                bag.append(((code + size) * mult % full) >> 48)
        whole = sum(((x + 1) * (2 * k + 1) * mult % full) ^ (x * base % full) for k, x in enumerate(points[1:-1])) % full
        bags.append([*bag, (whole * mult % full) >> 48])
    tops = []
    for begin in range(0, max(1, len(words) - 2), 2):
        window = [weight[b] for bag in bags[begin : begin + 4] for b in bag]
        if window:
            tops.append(float(np.mean(window)))
    return max(tops, default=0.0) + bias


@pytest.mark.parametrize("size", [None, 7, 40, 333])
def test_scores_equal_the_definition(monkeypatch, size):
    rng = np.random.default_rng(1)
    weight = rng.normal(size=toxicity.BUCKETS).astype(np.float32)
    letters = list("abcdeé日x1")
    texts = ["", "a", "ab cd", "one, two; three!", " " * 500 + "late", "x" * 700 + " y z"]
    texts += [" ".join("".join(rng.choice(letters, rng.integers(1, 9))) for _ in range(n)) for n in (3, 4, 5, 6, 7, 50, 151)]
    if size:
        monkeypatch.setattr(toxicity, "_SLICE_CHARS", size)
    for text in texts:
        assert toxicity.margins(text, weight, 0.5) == pytest.approx(plain_margin(text, weight, 0.5), abs=1e-5)


def test_toxicity_of_odd_tables(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1), (7, 0), (None, 1)], "doc_id long, toxic int")
    out = toxicity.classify(odd, labels).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    assert toxicity.classify(empty, labels.limit(0)).collect() == []


def test_held_out_labels_are_never_read(spark, small):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.crc_mod(F.col("doc_id")) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.training_sample(small, labels) == toxicity.training_sample(small, turned)


# --- 6: HTML --------------------------------------------------------------------------------------------------------

HTML = """<!DOCTYPE html><html><head><title>T</title><style>.ad, #x {display:none} p{margin:0}</style><script>var a="</p>";</script></head>
<body><h1>Head &amp; tail</h1><p>One <b>two<br><p>three</p> tail <div class="ad">AD</div><ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>
<table><tr><th>Name<th>N<tr><td>alpha beta<td>1<tr><td>g<td>22</table><pre> x
  y</pre><span style="display:none">no</span>a<!-- c -->b &lt;c&gt; < 5<details><summary>s</summary>hid</details></body></html>"""


def test_html_is_laid_out():
    assert htmltext.render(HTML) == "\n".join([
        "Head & tail", "", "One two", "", "three", "", "tail", "", "- a", "- b", "  3. c", "  4. d", "", "Name        N", "alpha beta  1", "g           22", "", " x", "  y", "", "ab <c> < 5", "s",
    ])


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\n\nb"), ("<div>a<div>b</div>c", "a\nb\nc"), ("a</p>b", "a\n\nb"), ("<table><td>x<table><td>y</table></table>", "x\n\ny"), ("<b>x</i>y", "xy"), ("a<!-- open", "a"), ("<script>x", ""), ("x<", "x<"), ("<a href='>'>k</a>", "k"), ("&nbsp;a&#65;", " aA"),
    ("<p hidden>no</p>yes", "yes"), ("<ul><li></ul>z", "z"), ("a<svg><title>t</title><g>x<text>in</text></g></svg>b", "a in b"), ("<math><mi>x</mi><mo>+</mo><annotation>tex</annotation></math>", "x+"), ("<textarea>a  b</textarea>", "a  b"),
])
def test_html_cases(html, text):
    assert htmltext.render(html) == text


@pytest.mark.parametrize("css, shown", [
    ("@media print {.m, p{display:none}}", True), (".m{display:none} @media (min-width:600px){.m{display:block}}", True), (".m{display:none} @media (max-width: 600px){.m{display:block}}", False),
    ("@media screen and (min-width: 40em) {p{display:none}}", False), ("@media not print{.m{display:none}}", False), ("@media not all and (min-width:9px){.m{display:none}}", True), (".m{display:none;display:block}", True),
    ("#i{display:block} .m{display:none}", True), (".m{display:none!important} #i{display:block}", False), ("@import url(x); @charset 'u'; .m{visibility:hidden}", False), ("@supports (display:grid){@media all{.m{display:none}}} p{}", False),
    ("@keyframes k{from{display:none}} @font-face{display:none}", True), ("/* .m{display:none} */", True), ("div .m{display:none}", True), (".m{color:red;display : none ;}", False), (".m{", True), ("@media{@media{@media{", True), ("}}.m{display:none}", False),
])
def test_style_sheets(css, shown):
    assert htmltext.render(f"<style>{css}</style><p class=m id=i>x</p>y") == ("x\n\ny" if shown else "y")


def test_a_style_attribute_beats_rules():
    assert htmltext.render("<style>.m{display:none} .n{display:block} .k{display:none!important}</style><b class=m style='display:inline'>a</b><b class=n hidden>b</b><b class=n style='display:none'>c</b><b class=k style='display:inline'>d</b>") == "ab"


def test_hidden_elements_at_any_depth():
    deep = lambda x, n=160: "<div>" * n + x + "</div>" * n
    assert htmltext.render(deep("<p hidden>secret</p>shown<p>too</p>")) == "shown\ntoo"
    assert htmltext.render("<div hidden>" + deep("secret", 200) + "</div>after") == "after"
    assert htmltext.render("<div hidden>" + deep("secret", 200) + "still</div>after") == "after"
    assert htmltext.render(deep("<pre>a\n  b</pre><details><summary>s</summary>no</details><svg><text>t</text>x</svg>")) == "a\n  b\ns\nt"


def plain_visible(node):
    """The words that are shown, by recursion over a tree of (tag, hidden, children)."""
    tag, hidden, children = node
    return [] if hidden else [w for c in children for w in ([c] if isinstance(c, str) else plain_visible(c))]


def test_visible_words_equal_brute_force():
    rng = np.random.default_rng(7)

    def tree(depth):
        tag = str(rng.choice(["div", "span", "p", "section", "b", "li"]))
        children = [f"w{rng.integers(10**6)}" if depth > 7 or rng.random() < 0.4 else tree(depth + 1) for _ in range(int(rng.integers(1, 5)))]
        return tag, bool(rng.random() < 0.12), children

    def html(node):
        tag, hidden, children = node
        how = str(rng.choice([" hidden", " style='display: none'", " class='gone'", " style='VISIBILITY:hidden'"])) if hidden else str(rng.choice(["", " id=a", " class='x y'"]))
        return f"<{tag}{how}>" + " ".join(c if isinstance(c, str) else html(c) for c in children) + f"</{tag}>"

    def nests(node, inside=()):
        """Whether the parser would close something early: blocks in a paragraph, items in items."""
        tag, _, children = node
        bad = ("p" in inside and tag in ("div", "p", "section", "li")) or (tag == "li" and "li" in inside)
        return bad or any(nests(c, (*inside, tag)) for c in children if not isinstance(c, str))

    compared = 0
    for _ in range(3000):
        root = tree(0)
        if not nests(root):
            compared += 1
            assert htmltext.render("<style>.gone{display:none}</style>" + html(root)).replace("- ", "").split() == plain_visible(root)
    assert compared > 200


def test_wide_cells_are_aligned():
    wide = "x" * 60
    out = htmltext.render(f"<table><tr><td>{wide}<td>1<tr><td>a<td>2<tr><td colspan=2>c<td>3</table>").split("\n")
    assert [line.index(c) for line, c in zip(out, "123", strict=True)] == [62, 62, 65]
    assert len(htmltext.render("<table>" + f"<tr><td>{'y' * 100_000}<td>z" + "<tr><td>a<td>b" * 5_000 + "</table>")) < 5_000_000


def test_html_of_any_depth_and_broken_html(spark):
    assert htmltext.render("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert htmltext.render("<div><b><p>" * 20_000 + "deep").split() == ["deep"]
    for broken in ("<" * 3000, "<a " * 2000, '<a b="' * 1500, "</" * 2000, "<table>" * 300 + "x"):
        assert isinstance(htmltext.render(broken), str)
    pages = spark.createDataFrame([(1, "u", HTML, "t"), (None, None, None, "t")], "page_id long, url string, html string, text string")
    assert sorted(r["n_chars"] for r in htmltext.extract(pages).collect())[0] == 0 and htmltext.extract(pages.limit(0)).collect() == []


# --- 7 and 9: tokens ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name, byte_level", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_chunks_give_the_ids_of_whole_texts(spark, small, name, byte_level):
    from tokenizers import Tokenizer

    texts = [r["text"] for r in small.limit(60).collect()] + [t for _, t, _, _ in ODD] + ["a, b.", "a.\nb", "x  y", "don't we're, it's.", "日本語, テスト. ok", "é, é. ñ", "\n", "<|endoftext|> x", "A.B, c.,d 12, 3.", "ß. İ, ΑΣ. Σ", "word' s, 's", "ª. º, ٣. ²", "à b c", "x.́ y", " lead", "trail "]
    plain = Tokenizer.from_file(tokens.vocabulary(name))
    encoder = tokens.Encoder(tokens.vocabulary(name), byte_level)
    for _ in range(2):  # from the model, then from what is kept
        for text, ids in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids


def test_best_fit():
    bins, offsets, fills = packing.best_fit([5, 4, 3, 2, 6], 10)
    assert len(fills) == 2 and sorted(fills) == [10, 10]
    assert all(fills[b] >= o + n for b, o, n in zip(bins, offsets, [5, 4, 3, 2, 6], strict=True))


def test_runs_are_packed_like_single_items():
    rng = np.random.default_rng(2)
    for _ in range(60):
        capacity = 40
        classes = [(int(f), int(n)) for f, n in zip(rng.integers(1, capacity + 1, 12), rng.integers(1, 6, 12), strict=True)]
        merged = packing.merge_runs([packing.Run(f, n, [(i, f, 0, 0)]) for i, (f, n) in enumerate(classes)], capacity)
        _, _, fills = packing.best_fit([f for f, n in classes for _ in range(n)], capacity)
        assert sorted(f for r in merged for f in [r.fill] * r.count) == sorted(fills)
        seen = set()
        for r in merged:
            assert sum(f for _, f, _, _ in r.parts) == r.fill <= capacity
            assert [o for *_, o in r.parts] == np.cumsum([0, *[f for _, f, _, _ in r.parts]])[:-1].tolist()
            for i, _, first, _ in r.parts:
                assert not seen & (own := {(i, k) for k in range(first, first + r.count)})
                seen |= own
        assert seen == {(i, k) for i, (_, n) in enumerate(classes) for k in range(n)}


def test_no_underfull_bin_is_left_out(spark, tmp_path):
    """Pieces of 1,100 tokens of one partition are joined by what other partitions could not place."""
    plain = tokens.Encoder(tokens.vocabulary("word_bpe_49k.json"), False)
    words = lambda n: " ".join(["a"] * (n - 1))
    assert len(plain.encode([words(1100)])[0]) == 4 * 1099
    for part, (first, count, size) in enumerate([(0, 900, 1100), *[(900 + i, 1, 900) for i in range(40)]]):
        spark.createDataFrame([(first + k, words(size)) for k in range(count)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "t" / f"part={part}"))
    docs = spark.read.option("maxPartitionBytes", 1).parquet(str(tmp_path / "t"))
    out = packing.pack(docs, tokens.vocabulary("word_bpe_49k.json")).collect()
    sizes = Counter()
    for r in out:
        sizes[r["sequence_id"]] += r["length"]
    assert len(out) == 940 and Counter(sizes.values()) == {1100: 860, 2000: 40}


def check_packing(rows, ids):
    sequences, lengths = defaultdict(list), Counter()
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(part.astype("<u4").tobytes()) == r["ids_crc32"] and r["start"] == 2048 * r["piece"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        lengths[r["doc_id"]] += r["length"]
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    return len(sequences), lengths


def test_packing(spark, small, tmp_path):
    from tokenizers import Tokenizer

    small.repartition(40).write.parquet(str(tmp_path / "many"))  # several levels of the tree
    docs = spark.read.option("maxPartitionBytes", 1).parquet(str(tmp_path / "many"))
    plain = Tokenizer.from_file(tokens.vocabulary("word_bpe_49k.json"))
    ids = {r["doc_id"]: np.array(plain.encode(r["text"], add_special_tokens=False).ids + [0]) for r in small.collect()}
    sequences, lengths = check_packing(packing.pack(docs, tokens.vocabulary("word_bpe_49k.json")).collect(), ids)
    assert lengths == {k: len(v) for k, v in ids.items()}
    assert sequences <= 1.05 * sum(lengths.values()) / 2048 + 1


def test_packing_of_odd_tables(odd, empty):
    out = packing.pack(odd, tokens.vocabulary("word_bpe_49k.json")).collect()
    assert len({r["doc_id"] for r in out}) == len({i for i, *_ in ODD}) and sum(r["length"] for r in out if r["doc_id"] in (1, 2, 4)) == 3
    assert packing.pack(empty, tokens.vocabulary("word_bpe_49k.json")).collect() == []


@pytest.mark.parametrize("ids", [[], [0], [255, 256, 65535, 65536, 2**32 - 1, 5], list(range(0, 70_000, 7))])
def test_direct_codes_give_any_id(ids):
    codes = tokenfile.DirectCodes.of(np.array(ids, np.uint32))
    assert codes.span(0, len(ids)).tolist() == ids
    for at in {0, 1, 2, 5, len(ids) // 2, len(ids) - 1} & set(range(len(ids))):
        assert codes[at] == ids[at] and codes.span(at, len(ids)).tolist() == ids[at:]
    with pytest.raises(IndexError):
        codes[len(ids)]


def test_single_ids_are_read_from_a_file(tmp_path):
    rng = np.random.default_rng(3)
    ids = np.concatenate([rng.integers(0, 2 ** int(bits), 700) for bits in rng.integers(1, 33, 9)]).astype(np.uint32)
    data = tokenfile.write_file([5, None, 7], [4000, 300, 2000], ids)
    (tmp_path / "f").write_bytes(data)
    read = []

    class Counting:
        def __init__(self, file):
            self.file, self.seek = file, file.seek

        def read(self, n):
            read.append(n)
            return self.file.read(n)

    with open(tmp_path / "f", "rb") as file:
        reader = tokenfile.TokenReader(Counting(file))
        assert len(reader) == len(ids)
        for at in rng.integers(0, len(ids), 300).tolist():
            read.clear()
            assert reader[at] == ids[at]
            assert sum(read) <= 4 * (1 + 64 + 4)
        with pytest.raises(IndexError):
            reader[len(ids)]
    whole = tokenfile.TokenFile(data)
    assert whole.keys == [5, None, 7] and np.array_equal(whole.document(1), ids[4000:4300])


def test_other_keys_than_integers_are_refused(spark, tmp_path):
    with pytest.raises(TypeError):
        tokenfile.write_files(spark.createDataFrame([("a", "b")], "doc_id string, text string"), str(tmp_path), "x")


def test_token_files(spark, small, odd, empty):
    from tokenizers import Tokenizer

    plain, start = Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json")), 0
    out = {r["doc_id"]: r for r in tokenfile.token_table(small, tokens.vocabulary("byte_bpe_50k.json")).collect()}
    for r in small.orderBy("doc_id").collect():
        ids = np.array(plain.encode(r["text"], add_special_tokens=False).ids + [2], "<u4")
        assert (out[r["doc_id"]]["start"], out[r["doc_id"]]["n_tokens"], out[r["doc_id"]]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    rows = sorted(tokenfile.token_table(odd, tokens.vocabulary("byte_bpe_50k.json")).collect(), key=lambda r: r["start"])
    assert rows[0]["doc_id"] is None and [r["doc_id"] for r in rows[1:]] == sorted(i for i, *_ in ODD if i is not None)
    assert tokenfile.token_table(empty, tokens.vocabulary("byte_bpe_50k.json")).collect() == []


# --- 8: media -------------------------------------------------------------------------------------------------------


def test_media_round_trip(odd, empty):
    out = media.media_table(odd).collect()
    assert len(out) == len(ODD)
    by_text = defaultdict(set)
    for r in out:
        text = next(t for i, t, *_ in ODD if i == r["doc_id"])
        raw = (text or "").encode()
        padded = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert r["media_sha256"] == hashlib.sha256(media.encode_wav(padded)).hexdigest() and r["media_bytes"] == len(padded) + 44
        assert len(r["times"]) == len(r["codes"]) and r["times"] == sorted(r["times"])
        by_text[text or ""].add((r["feature"], r["media_sha256"]))
    assert all(len(x) == 1 for x in by_text.values()) and media.media_table(empty).collect() == []


def plain_landmarks(payload):
    """Peaks and pairs from a Fourier transform written out frame by frame."""
    x = np.frombuffer(payload, np.uint8).astype(float) - 128
    window, turn = np.hanning(192), np.exp(-2j * np.pi * np.outer(np.arange(97), np.arange(192)) / 192)
    frames = [np.abs(turn @ (x[at : at + 192] * window)) for at in range(0, len(x) - 191, 96)]
    peaks, margin = [], 1e9
    for t, spectrum in enumerate(frames):
        for lo, hi in ((1, 12), (12, 36), (36, 97)):
            top = spectrum[lo:hi].max()
            sides = [round(frames[s][lo:hi].max(), 2) if 0 <= s < len(frames) else -1 for s in (t - 1, t + 1)]
            margin = min([margin, *(abs(top - frames[s][lo:hi].max()) for s in (t - 1, t + 1) if 0 <= s < len(frames))])
            if round(top, 2) > sides[0] and round(top, 2) >= sides[1] and top > 0:
                peaks.append((t, lo + int(spectrum[lo:hi].argmax())))
    pairs = [(t, a << 12 | b << 5 | u - t) for i, (t, a) in enumerate(peaks) for u, b in peaks[i + 1 : i + 4] if u - t <= 31]
    return sorted(pairs), margin


def test_landmarks_equal_the_definition():
    rng, compared = np.random.default_rng(4), 0
    for n in (1, 2, 5, 20, 60):
        for _ in range(4):
            payload = bytes(rng.integers(32, 127, 192 * n).astype(np.uint8))
            wanted, margin = plain_landmarks(payload)
            times, codes = media.landmarks(np.frombuffer(payload, np.uint8).astype(np.float32) - 128)
            if margin > 0.05:  # no two magnitudes so close that rounding decides
                compared += 1
                assert list(zip(times.tolist(), codes.tolist(), strict=True)) == wanted
    assert compared >= 10


def test_landmarks_follow_the_signal():
    t = np.arange(192 * 40)
    bins = lambda k: media._band_peaks((100 * np.sin(2 * np.pi * k * t / 192)).astype(np.float32))[0]
    for k, band in ((5, 0), (20, 1), (30, 1), (70, 2)):
        assert set(bins(k)[:-1, band].tolist()) == {k}


# --- 10: near dedup -------------------------------------------------------------------------------------------------


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(0)
    for weights in (lambda n: np.ones(n), lambda n: rng.integers(1, 6, n).astype(float)):
        estimates, wanted = [], []
        for _ in range(40):
            ids = rng.integers(0, 2**63, 300).astype(np.uint64)
            x, y = weights(300), weights(300)
            x[250:], y[:50] = 0, 0
            wanted.append(sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in range(50, 250)))
            estimates.append((neardedup.signature(ids[x > 0], x[x > 0]) == neardedup.signature(ids[y > 0], y[y > 0])).mean())
        assert np.mean(estimates) == pytest.approx(np.mean(wanted), abs=0.02)


def brute_classes(rows):
    """Connected components of exact Jaccard 0.8 over sets of five-word shingles."""
    import re

    words = [tuple(re.findall(r"[^\W_]+", (t or "").lower())) for _, t in rows]
    sets = [{w[i : i + 5] for i in range(len(w) - 4)} or ({w} if w else set()) for w in words]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = words[i] == words[j] or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
            if same:
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), k), k)
    return {k: least[root(i)] for i, (k, _) in enumerate(rows)}


def near_copies(seed, groups):
    rng = np.random.default_rng(seed)
    rows = []
    for size, edits in groups:
        base = [f"w{rng.integers(5000)}" for _ in range(int(rng.integers(60, 160)))]
        for _ in range(size):
            text = list(base)
            for _ in range(int(rng.integers(0, edits + 1))):
                text[rng.integers(len(text))] = f"e{rng.integers(10**6)}"
            rows.append((len(rows), " ".join(text)))
    return rows


def test_near_dedup_equals_brute_force(spark, tmp_path):
    rows = near_copies(3, [(90, 4), (40, 1), (5, 2), (3, 8), (2, 0), *[(1, 0)] * 40])
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    out = neardedup.dedup(docs).collect()
    assert {r["doc_id"]: r["class_id"] for r in out} == brute_classes(rows)
    classes = Counter(r["class_id"] for r in out)
    assert all(r["class_size"] == classes[r["class_id"]] and r["kept"] == (r["doc_id"] == r["class_id"]) for r in out)
    assert neardedup.keep_one(docs).count() == len(classes)


def test_near_copies_with_repeated_lines(spark, tmp_path):
    rng = np.random.default_rng(6)
    words = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 10**6, n))
    texts = []
    for times in (20, 40, 100):
        for _ in range(5):
            text, block = words(304), words(60)
            texts += [text, " ".join([text, *[block] * times])]
    line = words(60)
    texts += [" ".join([line] * 20 + [words(int(n))]) for n in rng.integers(1, 12, 30)]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "t"))
    out = neardedup.dedup(spark.read.parquet(str(tmp_path / "t"))).collect()
    assert {r["doc_id"]: r["class_id"] for r in out} == brute_classes(rows)


def edited(seed, n, length, least, most):
    """Copies of one text with ``least`` to ``most`` words replaced; the text itself is not among them."""
    rng = np.random.default_rng(seed)
    base, rows = [f"w{i}" for i in rng.integers(0, 10**6, length)], []
    for i in range(n):
        text = list(base)
        for at in rng.choice(length, int(rng.integers(least, most + 1)), replace=False):
            text[at] = f"e{rng.integers(10**7)}"
        rows.append((i, " ".join(text)))
    return rows


def test_a_group_around_the_limit_keeps_its_links(spark, tmp_path):
    rows = edited(4, 300, 250, 3, 6)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "t"))
    out = neardedup.dedup(spark.read.parquet(str(tmp_path / "t"))).collect()
    assert {r["doc_id"]: r["class_id"] for r in out} == brute_classes(rows)


def test_blocks_give_a_forest_of_links(spark, monkeypatch):
    monkeypatch.setattr(neardedup, "BLOCK", 40)
    monkeypatch.setattr(neardedup, "OPEN_BLOCK", 16)
    for n in (60, 120, 240):
        members = [(1, i, i, bytearray(neardedup.shingles(neardedup.word_hashes(t)[0])[0].tobytes())) for i, t in edited(9, n, 120, 0, 3)]
        frame = lambda rows: spark.createDataFrame(rows, "hub long, node long, component long, shingles binary")
        first = [(r["a"], r["b"]) for r in neardedup._block_links(frame(members), True).collect()]
        assert n / 2 < len(first) < n
        found = {r["node"]: r["component"] for r in neardedup.components(spark.createDataFrame(first, "a long, b long")).collect()}
        rest = [(h, i, found.get(i, i), x) for h, i, _, x in members]
        links = first + [(r["a"], r["b"]) for r in neardedup._block_links(frame(rest)).collect()]
        sets = {i: set(np.frombuffer(x, "<u8").tolist()) for _, i, _, x in members}
        assert all(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a, b in links)
        assert len(links) <= 2 * n


def test_near_dedup_of_odd_tables(odd, empty):
    out = neardedup.dedup(odd).collect()
    assert len(out) == len(ODD)
    ids = defaultdict(set)
    for r in out:
        ids[r["doc_id"]].add(r["class_id"])
    assert ids[1] == ids[2] == ids[4] == {1} and ids[3] == {3} and ids[None] == {None}
    assert neardedup.dedup(empty).collect() == [] and neardedup.keep_one(odd).columns == odd.columns


# --- The pipeline ---------------------------------------------------------------------------------------------------


def test_pipeline_equals_its_parts(spark, tmp_path):
    import corpus_pipeline

    docs, stage = spark.read.parquet(f"{SMALL}/documents.parquet"), dict(corpus_pipeline.STAGES)
    kept = {}
    current = docs
    for i, (name, f) in enumerate(corpus_pipeline.STAGES[:4]):
        out = f(spark, current, SMALL)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(i)))
        current = spark.read.parquet(str(tmp_path / str(i)))
        kept[name] = [(r["doc_id"], r["text"]) for r in current.collect()]
    norm = lambda t: "".join(c for c in t if c not in " \t\n\x0b\x0c\r")
    best = {}
    for i, t in kept["quality"]:
        best[norm(t)] = min(best.get(norm(t), (0, 1 << 60)), (-len(t), i))
    assert sorted(i for i, _ in kept["exact dedup"]) == sorted(i for _, i in best.values())
    classes = brute_classes(kept["exact dedup"])
    assert sorted(i for i, _ in kept["near dedup"]) == sorted(set(classes.values()))
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(spark.read.parquet(str(tmp_path / "2"))).collect()}
    words = Counter()
    for i, t in kept["mixing"]:
        words[i] += len(t.split())
    assert words == {i: n for i, n in taken.items() if n}
    out = stage["packing"](spark, current, SMALL).collect()
    assert sum(r["length"] for r in out if r["piece"] >= 0) == sum(len(x) // 4 + 1 for x in tokens.Encoder(tokens.vocabulary("word_bpe_49k.json"), False).encode([t for _, t in kept["mixing"]]))


def test_pipeline_keeps_what_its_parts_say(spark, tmp_path):
    """The quality stage against the classifier's own verdicts, the packing stage against plain best-fit."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs, labels, stage = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"), dict(corpus_pipeline.STAGES)
    good = {r["doc_id"] for r in quality.classify(docs, labels).where("kept").collect()}
    kept = stage["quality"](spark, docs, SMALL)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(good) and kept.columns == docs.columns
    plain = Tokenizer.from_file(tokens.vocabulary("word_bpe_49k.json"))
    ids = {r["doc_id"]: np.array(plain.encode(r["text"] or "", add_special_tokens=False).ids + [0]) for r in docs.collect()}
    sequences, lengths = check_packing(stage["packing"](spark, docs, SMALL).collect(), ids)
    assert lengths == {k: len(v) for k, v in ids.items()}
    pieces = [min(2048, len(v) - at) for v in ids.values() for at in range(0, len(v), 2048)]
    assert sequences == len(packing.best_fit(pieces, 2048)[2])


def test_pipeline_of_odd_tables(spark, odd, empty, tmp_path):
    import corpus_pipeline

    for name, docs in (("odd", odd), ("none", empty)):
        folder = tmp_path / name
        docs.write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(3, 1), (5, 1), (None, 0)] if name == "odd" else [], "doc_id long, quality int").write.parquet(str(folder / "labels.parquet"))
        out = corpus_pipeline.run(spark, str(folder)).collect()
        assert (name == "none") == (not out) and all(r["length"] <= 2048 for r in out)
    for name, f in corpus_pipeline.STAGES[:4]:
        assert f(spark, odd, str(tmp_path / "odd")).columns == odd.columns, name
