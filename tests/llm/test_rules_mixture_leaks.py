"""Quality rules, mixing and decontamination."""
import collections
import math
import random

from pyspark.sql import functions as F

from impressa.llm import decontaminate as C
from impressa.llm import mixture as M
from impressa.llm import quality_rules as Q
from util import DOCS, WORD, edge_docs, no_docs, words

SF = "/root/testdata/sf0.001"


def base_features(text):
    w, t = words(text), text or ""
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    count = collections.Counter(windows)
    covered = {p for i, x in enumerate(windows) if count[x] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in Q.SYMBOLS for c in t), len(lines) - len(set(lines)), len(covered))


def test_features_equal_brute_force(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("a b c dd #e $ % é".split()) + rng.choice(["", "\n", "\t"]) for _ in range(rng.randint(0, 60)))
             for _ in range(150)]
    docs = edge_docs(spark, [(100 + i, t, "en", "s", 0) for i, t in enumerate(texts)])
    for r in Q.with_features(docs).collect():
        assert tuple(r[c] for c in Q.FEATURES[:5]) == base_features(r.text)


def test_op10_base_columns(spark):
    rows = {r.doc_id: r for r in Q.op10(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        f, r = base_features(d.text), rows[d.doc_id]
        assert tuple(r[c] for c in Q.FEATURES[:5]) == f
        assert r.base_failed == (f[0] < 50 or 100 * f[4] > 50 * f[0]) and not (r.base_failed and r.kept)


def test_binomial_tail_is_exact(spark):
    cases = [(10, 0, 0.05), (200, 3, 0.05), (3000, 5, 0.004), (50, 49, 0.05), (100_000, 300, 0.004)]
    df = spark.createDataFrame([(n, k) for n, k, _ in cases], "n long, k long")
    for n, k, a in cases:
        got = df.where((F.col("n") == n) & (F.col("k") == k)).select(Q.log_binomial_tail(F.col("n"), F.col("k"), a)).collect()[0][0]
        if k >= n * a:
            assert got == 0
            continue
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(a) + (n - i) * math.log1p(-a)
                for i in range(k + 1)]
        top = max(logs)
        assert abs(got - (top + math.log(sum(math.exp(x - top) for x in logs)))) < 1e-6


def _scored(spark, good, bad, stratum="en", copies=1):
    """``good`` and ``bad`` hold (share of symbols, number) pairs of labelled documents, ``copies`` rows a text."""
    rows, labels, i = [], [], 0
    for label, groups in ((1, good), (0, bad)):
        for share, n in groups:
            for _ in range(n):
                rows.append((i, stratum, 100, 1000, int(1000 * share), 0, 0, 10, 0, 0, i // copies))
                labels.append((i, label))
                i += 1
    cols = "doc_id long, lang string, " + ", ".join(f"{c} long" for c in [*Q.FEATURES, Q.TRIAL])
    return spark.createDataFrame(rows, cols), spark.createDataFrame(labels, "doc_id long, quality int")


def test_cutoffs_are_certified_or_absent(spark):
    scored, labels = _scored(spark, [(0.0, 3000), (0.9, 1)], [(0.3, 200)])
    c = {r.rule: r for r in Q.certified_cutoffs(scored, labels).collect()}
    assert set(c) == {"symbols"} and c["symbols"].cutoff < 0.3 and c["symbols"].k == 1 and c["symbols"].n == 3001
    kept = Q.apply_cutoffs(scored, Q.certified_cutoffs(scored, labels)).where("kept").count()
    assert kept == 3000
    few, few_labels = _scored(spark, [(0.0, 100)], [(0.3, 50)])  # too few to prove anything
    assert Q.certified_cutoffs(few, few_labels).count() == 0
    risky, risky_labels = _scored(spark, [(0.0, 2000), (0.3, 200)], [(0.3, 500)])  # would reject a tenth of the good
    assert Q.certified_cutoffs(risky, risky_labels).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.certified_cutoffs(scored, none).count() == 0


def test_copies_are_one_trial_and_null_is_a_stratum(spark):
    scored, labels = _scored(spark, [(0.0, 4000)], [(0.3, 200)], copies=4000)
    assert Q.certified_cutoffs(scored, labels).count() == 0  # one text, whatever its number of rows
    scored, labels = _scored(spark, [(0.0, 6000)], [(0.3, 200)], copies=2)
    assert {(r.rule, r.n, r.k) for r in Q.certified_cutoffs(scored, labels).collect()} == {("symbols", 3000, 0)}
    text = " ".join(f"word{i}" for i in range(60))
    near, far = text + " end", " ".join(f"other{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text), (3, near), (4, far), (5, "one two"), (6, None)], "doc_id long, text string")
    least = {r.doc_id: r[Q.TRIAL] for r in Q.with_features(docs).collect()}
    assert least[1] == least[2] != least[4] and least[5] is None and least[6] is None
    # a null and an empty language are two strata: the correction counts both
    one, ones = _scored(spark, [(0.0, 1450)], [(0.3, 200)])
    two = one.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "")).unionByName(one.withColumn("doc_id", F.col("doc_id") + 10_000))
    assert two.select("lang").distinct().count() == 3
    assert {r.n for r in Q.certified_cutoffs(two, ones.unionByName(ones.withColumn("doc_id", F.col("doc_id") + 10_000))).collect()} <= {1450}


def test_certified_share_holds_with_copies(spark):
    """Holdouts whose good texts are copied a random number of times: the certified cutoffs reject more than
    the allowed share of distinct good texts in at most a few of the draws."""
    broken = 0
    for seed in range(6):
        rng = random.Random(seed)
        rows, labels, i = [], [], 0
        for t in range(2500):
            share = 0.3 if rng.random() < 0.006 else 0.0  # a rule's allowance is 0.004
            for _ in range(rng.choice([1, 1, 1, 5, 40]) if share == 0 else 1):
                rows.append((i, "en", 100, 1000, int(1000 * share), 0, 0, 10, 0, 0, t))
                labels.append((i, 1))
                i += 1
        rows += [(i + j, "en", 100, 1000, 300, 0, 0, 10, 0, 0, 10_000 + j) for j in range(50)]
        labels += [(i + j, 0) for j in range(50)]
        cols = "doc_id long, lang string, " + ", ".join(f"{c} long" for c in [*Q.FEATURES, Q.TRIAL])
        broken += Q.certified_cutoffs(spark.createDataFrame(rows, cols), spark.createDataFrame(labels, "doc_id long, quality int")).count() > 0
    assert broken <= 1


def test_quality_rules_edges(spark):
    labels = spark.createDataFrame([(5, 1), (5, 0), (None, 1), (6, None)], "doc_id long, quality int")
    docs = edge_docs(spark)
    out = Q.quality_rules(docs, labels)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [5, 6]
    assert Q.quality_rules(no_docs(spark), labels).count() == 0


def water_level(sizes):
    """Targets by the contract's own words: cap, share the excess again, until none is above."""
    total = sum(sizes.values())
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + ([None] if None in sizes else [])
    weight = {n: 1 + i % 3 for i, n in enumerate(names)}
    capped = set()
    while True:
        rest = total - sum(3 * sizes[n] for n in capped)
        free = sum(weight[n] for n in names if n not in capped)
        above = [n for n in names if n not in capped and rest * weight[n] / free > 3 * sizes[n]]
        if not above:
            return {n: 3 * sizes[n] if n in capped else rest * weight[n] / free for n in names}
        capped |= set(above)


def test_mix_targets_and_caps(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        source = rng.choice(["big"] * 12 + ["b", "Z", "é", None, "tiny", "c"])
        n = rng.randint(1, 12) if source == "tiny" else rng.randint(0, 600)
        rows.append((i, rng.choice([" ", "\n "]).join(f"w{rng.randint(0, 99)}" for _ in range(n)), "en", source, 0))
    docs = spark.createDataFrame(rows, DOCS)
    placed, sources = M.located(docs)
    sizes = collections.defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want = water_level(sizes)
    got = {r.source: r for r in sources.collect()}
    for name, target in want.items():
        assert abs(got[name].target - target) <= 1e-9 * max(target, 1) and got[name].source_size == sizes[name]
    slots = M.mix(placed, sources)
    taken = collections.Counter()
    per_doc = collections.Counter()
    name_of = {r.sid: r.source for r in sources.collect()}
    doc_of = {(r.sid, r.start): r.doc_id for r in placed.where("size > 0").collect()}
    for r in slots.collect():
        taken[name_of[r.sid]] += r.n_words
        per_doc[doc_of[r.sid, r.start]] += r.n_words
    for name, target in want.items():
        assert abs(taken[name] - target) <= max(M.BLOCK, 0.02 * target) and taken[name] <= 3 * sizes[name]
    for i, t, *_ in rows:
        assert per_doc[i] <= 3 * len(words(t))
    mixed = collections.Counter()
    text_of = {r[0]: r[1] for r in rows}
    for r in M.mixed_documents(docs).collect():
        mixed[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text) and set(words(r.text)) <= set(words(text_of[r.doc_id]))
    assert mixed == per_doc
    again = sorted(map(tuple, M.mix(*M.located(docs.repartition(7))).collect()))
    assert again == sorted(map(tuple, slots.collect()))


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 7, 64, 1000):
        out = spark.range(n).select(M.permuted(F.col("id"), F.lit(n), F.lit(3), F.lit(1)).alias("p")).collect()
        assert sorted(r.p for r in out) == list(range(n))


def test_op5_and_mix_edges(spark):
    rows = M.op5(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    docs = edge_docs(spark)
    out = M.mixed_documents(docs).collect()
    assert {r.doc_id for r in out} <= {4, 5, 6, 7, None}
    assert M.mixed_documents(no_docs(spark)).count() == 0
    clash = docs.withColumnsRenamed({"lang": "pieces", "n_chars": "size"})
    assert M.mixed_documents(clash).columns == clash.columns


def test_shards_draw_their_source_counts(spark):
    slots = {1: 1000, 2: 333, 3: 77, 4: 5, 5: 0}
    sources = spark.createDataFrame([(i, n, n) for i, n in slots.items()], "sid int, blocks long, slots long")
    rows = M.shard_counts(sources, 16).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, M.shard_counts(sources.repartition(3), 16).collect()))
    total, shards = sum(slots.values()), max(r.shard for r in rows) + 1
    assert shards == -(-total // 16) and {r.sid for r in rows} == {1, 2, 3, 4}
    drawn = {1: [], 2: [], 3: [], 4: []}
    for shard in range(shards):
        mine = {r.sid: r for r in rows if r.shard == shard}
        size = 16 if shard < shards - 1 else total - 16 * (shards - 1)
        assert sum(r.n for r in mine.values()) == size
        for sid, r in mine.items():
            assert r.n >= int(slots[sid] * size / total) and r.first == sum(drawn[sid])
            drawn[sid].append(r.n)
    for sid, got in drawn.items():  # random from shard to shard, with the mean of the target
        p = slots[sid] / total
        deviation = (16 * p % 1 * (1 - 16 * p % 1) * shards * 2) ** .5
        assert abs(sum(got) - slots[sid]) <= 4 * deviation + 2 and (len(set(got[:-1])) > 1)
    big = [r for r in rows if r.sid == 2]
    assert 0.2 < sum(r.n > int(333 * 16 / total) for r in big) / len(big) < 1.0


ITEM = ("A train leaves Paris with 60 passengers and after 15 km it picks up 60 more people at the small station near "
        "Lyon before it travels on for 30 minutes towards the coast")


def test_reparameterised_and_inconsistent_texts(spark):
    changed = ITEM.replace("60", "75").replace("15 km", "20 miles").replace("Paris", "Berlin").replace("Lyon", "Hamburg")
    broken = ITEM.replace("with 60", "with 75")  # one slot value became two
    other = "Completely different words about gardens and rivers that have nothing in common with any of the questions at all here"
    rows = [(1, f"Some words first. {ITEM} and more text.", "en", "a", 0), (2, f"intro words\n{changed.upper()}", "en", "a", 0),
            (3, f"so it goes: {changed} indeed", "en", "a", 0), (4, broken, "en", "a", 0), (5, other, "en", "a", 0),
            (6, " ".join(ITEM.split()[:9]), "en", "a", 0)]
    benchmark = spark.createDataFrame([(10, ITEM), (11, ITEM), (12, None), (13, ""), (14, "5 6 7 8"), (None, "x y z w v u t s r")],
                                      "item_id long, text string")
    docs = edge_docs(spark, [(r[0] + 100, *r[1:]) for r in rows])
    found = C.with_row_key(docs).join(C.contaminated(docs, benchmark), "__k").collect()
    by_id = {r.doc_id: r.item_id for r in found}
    assert by_id == {101: 10, 103: 10}
    kept = C.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2
    assert C.decontaminate(no_docs(spark), benchmark).count() == 0
    empty = benchmark.limit(0)
    assert C.decontaminate(docs, empty).count() == docs.count()


def test_op3_finds_planted_passages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    flat = lambda t: " ".join(words((t or "").lower()))
    want = {(d.doc_id, b.item_id) for d in docs for b in bench if f" {flat(b.text)} " in f" {flat(d.text)} "}
    assert want <= {(r.doc_id, r.item_id) for r in C.op3(spark, SF).collect()}


def test_verbatim_items_without_literals(spark):
    short, names, chinese, late = "Who wrote Pride and Prejudice?", "Anna Maria Lopez, Juan Carlos Perez, 1984, 1985", "谁写了红楼梦这本书？", \
        "Trains that leave at 7 need 12 hours"
    benchmark = spark.createDataFrame([(1, short), (2, names), (3, chinese), (4, ITEM), (5, late)], "item_id long, text string")
    rows = [(101, f"Quiz night, {short} Nobody knew."), (102, f"the list: {names} and so on"), (103, f"昨天老师问我们{chinese}没有人知道"),
            (104, f"see below\n{ITEM.upper()}"), (105, f"see below\n{ITEM.title()}"), (106, "who wrote war and peace"),
            (107, f"Chapter one, {late.replace('7', '9').replace('12', '20')} today"), (108, "红楼梦是一本书")]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], DOCS)
    found = C.with_row_key(docs).join(C.contaminated(docs, benchmark), "__k").collect()
    assert {r.doc_id: r.item_id for r in found} == {101: 1, 102: 2, 103: 3, 104: 4, 105: 4, 107: 5} and len(found) == 6


TRAIN = "A train leaves Boston at 60 km per hour and reaches Denver after 5 hours how far apart are they"


def brute_tokens(text):
    """The template tokens of a text, one word after the other."""
    out, before, start = [], "", True
    for w in words("".join(c for c in text or "" if c not in "\x01\x02\x03\x04")):
        core = "".join(c for c in w if c not in C.PUNCTUATION)
        number = lambda c: any(x in "0123456789" for x in c) or all(p in C.NUMBERS or p == "one" and k for k, p in enumerate(c.lower().split("-")))
        if core:
            t = core.lower()
            if number(core):
                t = C.NUM
            elif t in C.UNITS and before and number(before):
                t = C.UNIT
            elif core[0] != core[0].lower() and not start:
                t = C.NAME
            if out and t in (C.NUM, C.NAME) and out[-1][1] == t:
                out[-1] = (out[-1][0] + " " + core, t)
            else:
                out.append((core, t))
            before, start = core, False
        if w[-1] in ".!?:":  # the next word begins a sentence
            before, start = "", True
    return out


def brute_matches(doc, item):
    """Whether consistent alignments of template windows cover enough of the item."""
    b, d = brute_tokens(item), brute_tokens(doc)
    if not b:
        return False
    size = min(len(b), C.WINDOW)
    variants = [[t for _, t in b]]
    if b[0][0][0] != b[0][0][0].lower() and b[0][1] != C.NUM and (len(b) < 2 or b[1][1] != C.NAME):
        variants.append([C.NAME] + variants[0][1:])
    useful = collections.defaultdict(set)
    for v, ts in enumerate(variants):
        for at in range(len(b) - size + 1 if v == 0 else 1):
            w = tuple(ts[at:at + size])
            if sum(t not in (C.NUM, C.UNIT, C.NAME) for t in w) >= C.MIN_LITERAL:
                useful[w].add(at)
    every = {at for ats in useful.values() for at in ats}
    runs = collections.defaultdict(set)
    for pos in range(len(d) - size + 1):
        for at in useful.get(tuple(t for _, t in d[pos:pos + size]), ()):
            runs[pos - at].add(at)
    covered = set()
    for shift, ats in runs.items():
        places = {p for a in ats for p in range(a, a + size)}
        pairs = {(d[p + shift][1], b[p][0], d[p + shift][0]) for p in places if d[p + shift][1] in (C.NUM, C.UNIT, C.NAME)}
        if len({x[:2] for x in pairs}) == len(pairs) == len({(x[0], x[2]) for x in pairs}) and \
                sum(t == C.NAME and x.lower() != y.lower() for t, x, y in pairs) <= C.MAX_RENAMED * len(places):
            covered |= ats
    return bool(every) and len(covered) >= C.MIN_SHARE * len(every)


def test_templates_equal_brute_force(spark):
    texts = [d.text for d in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] + [
        TRAIN, "In New York City five hundred of twenty-one Big Cats ate 5 6 7 kg. Ann Lee said: Hello World! one two \x01x\x02 \x03 km", None, "", "... !"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    for r in df.select("text", C.tokens(F.col("text")).alias("a"), C.hashes(F.col("text")).alias("h")).collect():
        want = brute_tokens(r.text)
        assert [(x.raw, x.t) for x in r.a] == want and len(r.h.t) == len(want)
        assert len(r.h.raw) == len([w for w in words(r.text) if set(w) - set(C.PUNCTUATION + "\x01\x02\x03\x04")])


def test_recall_on_new_parameters_and_german_sentences(spark):
    rng = random.Random(3)
    cities, things = ["Boston", "New York", "San Francisco", "Rio de Janeiro", "Rome", "Los Angeles", "Lyon", "Sao Paulo"], "boxes trains ships parcels coaches".split()
    shapes = ["A {t} full of {t2} leaves {a} at {n} km per hour and reaches {b} after {m} hours how far apart are the two places",
              "Every week the factory near {a} sends {n} {t} to the shop in {b} which sells {m} of them each day until none is left",
              "The bridge between {a} and {b} is {n} meters long and each of the {t} crossing it pays {m} dollars at the gate"]

    def fill(shape, t, t2):
        a, b = rng.sample(cities, 2)
        n, m = rng.sample(["7", "60", "twelve", "ninety", "twenty-five", "three hundred", "1,250"], 2)
        return shape.format(a=a, b=b, n=n, m=m, t=t, t2=t2)
    items, docs, want = [], [], set()
    for i in range(30):
        shape, t, t2 = rng.choice(shapes), rng.choice(things), rng.choice(things)
        shape = f"{rng.choice('red green old new tall'.split())} number {i} said " .replace(str(i), "x" + "abcdefghijklmnopqrstuvwxyzäöüß"[i]) + shape[0].lower() + shape[1:]
        items.append((i, fill(shape, t, t2)))
        docs.append((i, f"Some text goes before it. {fill(shape, t, t2)} and after"))
        want.add((i, i))
    items += [(100, TRAIN), (101, "Der Hund jagt die Katze durch den Garten und beißt den Postboten in das Bein vor dem Haus")]
    docs += [(100, TRAIN.replace("Boston", "New York").replace("Denver", "San Francisco")), (101, TRAIN.replace("60", "sixty").replace("after 5", "after nine")),
             (102, "so Der Mann jagt die Maus durch den Keller und beißt den Nachbarn in das Ohr vor dem Tor"),  # another sentence of one shape
             (103, "so der Hund jagt die Katze durch den Garten und beißt den Postboten in das Bein vor dem Haus heute"),
             (104, "A train leaves Boston and nothing else of the question stands here at all today")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in C.with_row_key(d).join(C.contaminated(d, bench), "__k").collect()}
    assert {(100, 100), (101, 100), (103, 101)} <= got and not {i for i, _ in got} & {102, 104}
    assert len(got & want) >= 0.9 * len(want)
    brute = {(i, j) for i, t in docs for j, u in items if brute_matches(t, u)}
    assert brute <= got


def test_op3_equals_brute_force(spark):
    docs = [d for d in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    first = {}
    for b in bench:
        first[b.text] = min(first.get(b.text, b.item_id), b.item_id)
    brute = {(d.doc_id, i) for d in docs for t, i in first.items() if brute_matches(d.text, t)}
    got = {(r.doc_id, r.item_id) for r in C.op3(spark, SF).collect()}
    assert brute <= got
