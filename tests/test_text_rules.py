"""Token rules, modified sentiment and mergeable distinct counts: hand examples, invariants and edges."""
import math
import random

from pyspark.sql import functions as F

from impressa.functions.text import rule_words, tokenize_rules
from impressa.operators import analytics as G
from impressa.operators import losses as L
from impressa.operators import metric_store as MS


def test_token_rules(spark):
    cases = {
        "Don't stop, it's 3,000.50 now.": ["do", "n't", "stop", ",", "it", "'s", "3,000.50", "now", "."],
        'He said "hello there" (twice).': ["he", "said", "``", "hello", "there", "''", "(", "twice", ")", "."],
        "Mr. Smith can't or cannot go to the U.S. now. Why?": [
            "mr.", "smith", "ca", "n't", "or", "can", "not", "go", "to", "the", "u.s.", "now", ".", "why", "?"],
        "wait... we'll gonna see -- the dogs' toys; $5 & 7%": [
            "wait", "...", "we", "'ll", "gon", "na", "see", "--", "the", "dogs", "'", "toys", ";", "$", "5", "&", "7", "%"],
        "time: 10:30, a: b": ["time", ":", "10:30", ",", "a", ":", "b"],
        "the dog's cat's don't won't": ["the", "dog", "'s", "cat", "'s", "do", "n't", "wo", "n't"],
        "  \t\n": [], "": [], None: [],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "id long, text string")
    got = {r.text: r.t for r in df.select("text", tokenize_rules("text").alias("t")).collect()}
    assert got == cases
    plain = spark.createDataFrame([("A b. C",)], "text string").select(tokenize_rules("text", rules=(), abbreviations=("b",)).alias("t"))
    assert plain.first().t == ["a", "b.", "c"]


def test_rules_give_the_tokens_of_each_word(spark):
    rng = random.Random(5)
    pieces = list(" \t\n\x0b\f\r\u00a0\u2028\"'`.,:;!?-([{<>}])$&%#@09aZ\u03a3\u0130") + [
        "  ", "''", "...", "--", "n't", "'s", "'ll", "can", "cannot", "gimme", "gonna", "gotta", "d'ye", "more'n", "'tis", "'twas", "mr.", "u.s.", "\U0001f600"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(3000)] + [None, "", "cannot cannot can't", "'tis 'tis"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    whole = {r.id: r.t for r in df.select("id", tokenize_rules("text").alias("t")).collect()}
    words = df.select("id", F.posexplode(rule_words("text")).alias("at", "word")).select("id", "at", tokenize_rules("word").alias("t"))
    parts = {}
    for r in sorted(words.collect(), key=lambda r: (r.id, r.at)):
        parts.setdefault(r.id, []).extend(r.t)
    assert len(whole) == len(texts) and all(parts.get(i, []) == t for i, t in whole.items())


def test_modified_sentiment_is_the_fold(spark):
    lexicon = spark.createDataFrame([("good", 2.0), ("bad", -3.0), ("less", 1.0)], "token string, valence double")
    mods = spark.createDataFrame([("not", None, True), ("very", 0.293, False), ("slightly", -0.293, None), ("less", -0.5, True)],
                                 "token string, boost double, negates boolean")
    texts = ["good", "very good", "x very bad", "not good", "not very good", "not x y good", "not x y z good", "less good",
             "slightly bad not very very good", "", None, "nothing known", "good good " * 50]

    def fold(text):
        toks, val, mod = (text or "").split(), {"good": 2.0, "bad": -3.0, "less": 1.0}, {"not": (0, True), "very": (.293, False), "slightly": (-.293, False)}
        total = 0.0
        for i, t in enumerate(toks):
            if t in val:
                v = val[t]
                for k, w in enumerate((1.0, .95, .9), 1):
                    boost, neg = mod.get(toks[i - k], (0, False)) if i >= k else (0, False)
                    v = (v + math.copysign(1, v) * boost * w) * (-.74 if neg else 1)
                total += v
        return total / math.sqrt(total * total + 15)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.sentiment for r in L.modified_sentiment(df, "id", "text", lexicon, mods).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert abs(got[i] - fold(t)) < 1e-12, t
    assert L.modified_sentiment(df.limit(0), "id", "text", lexicon, mods).count() == 0
    plain = {r.id: r.sentiment for r in L.lexicon_sentiment(df, "id", "text", lexicon).collect()}
    none = {r.id: r.sentiment for r in L.modified_sentiment(df, "id", "text", lexicon, mods.limit(0)).collect()}
    assert all(abs(plain[i] - none[i]) < 1e-12 for i in plain)


def test_distinct_sketches_merge_over_stored_days(spark, tmp_path):
    rows = spark.range(200_000).select((F.col("id") % 7).cast("string").alias("day"), (F.col("id") * 3 % 60_000).alias("user"),
                                       F.when(F.col("id") % 2 == 0, F.col("id") % 50).alias("item"))
    parts, path = G.distinct_sketches(rows, "day", ["user", "item"]), str(tmp_path / "sketches")
    MS.write_partials(parts.where("day < '4'"), path, "day")
    MS.write_partials(parts.where("day < '2'"), path, "day")  # a repeated run replaces its parts
    left = MS.pending(rows, MS.read_partials(spark, path, "day", MS.SKETCHES), "day")
    assert {r.day for r in left.select("day").distinct().collect()} == {"4", "5", "6"}
    MS.write_partials(G.distinct_sketches(left, "day", ["user", "item"]), path, "day")
    stored = MS.read_partials(spark, path, "day", MS.SKETCHES)
    merged = {r.metric: r.n for r in G.merge_distinct(stored).collect()}
    whole = {r.metric: r.n for r in G.merge_distinct(G.distinct_sketches(rows.withColumn("day", F.lit("all")), "day", ["user", "item"])).collect()}
    assert merged == whole and merged["item"] == 25
    assert abs(merged["user"] - 20_000) <= 4 * G.SKETCH_ERROR / 2 ** (G.SKETCH_LG_K / 2) * 20_000
    by = {(r.day, r.metric): r.n for r in G.merge_distinct(stored, ["day"]).collect()}
    assert len(by) == 14 and all(n <= 25 for (_, m), n in by.items() if m == "item")
    empty = G.merge_distinct(G.distinct_sketches(rows.limit(0), "day", ["user"]))
    assert empty.count() == 0
