"""Benchmark decontamination by template canonicalisation.

Every text becomes a sequence of template tokens: words without punctuation in lower case, with
numbers (in digits or words), units after a number, and names (capitalised words inside a sentence)
replaced by typed placeholders; a run of numbers or of names is one placeholder with the whole run as
its value, so "New York" fits where "Boston" stood.  Windows of ``WINDOW`` template tokens of all documents are hash-joined to those of
the benchmark.  Matches of a (document, item) pair are grouped by their alignment (document
position minus item position); an alignment counts only if its slots are consistent, that is if
the item's slot values and the document's values at the same places map one to one, and if at most
a share ``MAX_RENAMED`` of its places are names that changed (each changed name counts once): where
many capitalised words differ, as between two German sentences of one shape, another thing is asked.  So a
question that was re-parameterised (other numbers, names or units) is caught, while a text that
merely has the same shape with unrelated values in one slot is not.  A document is contaminated by
an item if consistent alignments cover at least ``MIN_SHARE`` of the item's windows.

Template windows with fewer than ``MIN_LITERAL`` literal tokens say nothing about an item and are not
used, and in capitals every word looks like a name.  So all windows of an item are also joined by
their raw tokens in lower case: a document that has ``MIN_SHARE`` of them verbatim is contaminated
too, whatever their templates are, unless its slots were found inconsistent and a part of the
item is missing.  There, each character of a script written without spaces is a
token.  The capitalised first word of an item may be a name or not; its first window has both
templates.

Only DataFrame functions run.  Documents send (row key, window hash) to a join with the
benchmark's windows, which are broadcast only after their number was checked, and shuffled
otherwise; nothing is collected.

Defined cases: null or empty texts have no window; an item of fewer than ``WINDOW`` tokens is one
window of its own length, and one with fewer than ``MIN_LITERAL`` literals matches verbatim only; equal
benchmark texts count as the smallest item_id; a null item_id is an item; repeated documents are
judged alike; extra columns are kept (names that begin with two underscores are reserved).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impressa.llm.exprs import SEPARATOR_RUN, let
from impressa.llm.registry import query, table
from impressa.session import cut_lineage

WINDOW, MIN_LITERAL, MIN_SHARE = 8, 4, 0.5
MAX_RENAMED = 0.25
MAX_BROADCAST = 500_000  # windows of 8 bytes
# Units recognised after a number, and the characters that are not part of a word.
UNITS = ("km m cm mm mi miles mile feet foot ft inches inch kg g mg lb lbs pounds pound oz tons ton l ml litres liters "
         "gallons hours hour h minutes minute min seconds second s days day weeks week months month years year "
         "dollars dollar cents euros euro eur usd gbp percent degrees mph kmh watts volts hz kb mb gb").split()
PUNCTUATION = ".,;:!?\"'()[]{}<>«»“”‘’„¿¡…"
# Number words in English, German, French and Spanish; with hyphens between them too.
NUMBERS = ("zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
           "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion "
           "null zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn zwanzig dreißig vierzig fünfzig "
           "sechzig siebzig achtzig neunzig hundert tausend deux trois quatre cinq sept huit neuf dix onze douze treize quatorze "
           "quinze seize vingt trente quarante cinquante soixante cent mille dos tres cuatro cinco seis siete ocho nueve diez once "
           "doce trece catorce quince veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien mil").split()
HYPHENED = f"^(?:{'|'.join(NUMBERS)})(?:-(?:one|{'|'.join(NUMBERS)}))+$"
NUM, UNIT, NAME = "<num>", "<unit>", "<name>"
# Scripts written without spaces, and their punctuation.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
BEYOND = r"[\u0E00-\uFFFF\x{10000}-\x{10FFFF}]"  # where all of them lie; a quick test
WIDE = "。，、？！：；「」『』（）《》"


# Marks that join tokens while runs are formed, and the end of a sentence; they are no part of a word.
_ON, _NEXT, _IS, _END = "\x01", "\x02", "\x03", "\x04"
_ENDERS = "[.!?:]"
_SIGNS = "[" + "".join("\\" + c for c in PUNCTUATION if c not in _ENDERS[1:-1]) + "\\x01-\\x04]"


def _clean(text: Column) -> Column:
    """``text`` without punctuation, but with an ``_END`` behind each word whose last character ends a sentence.
    Whole texts are rewritten, which costs far less than words one by one."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), f"{_SIGNS}|{_ENDERS}(?![ \\t-\\r]|\\z)", "")
    return F.regexp_replace(kept, _ENDERS, f" {_END} ")


def _split(text: Column) -> Column:
    return F.array_remove(F.split(text, SEPARATOR_RUN), "")


def _templates(text: Column, make) -> Column:
    """``make(cores, lows, templates)``: the words of a text without punctuation, the same in lower case, and
    their templates; all three hold an ``_END`` where a sentence ends."""
    def number(low: Column) -> Column:
        return low.rlike("[0-9]") | low.isin(NUMBERS) | (low.contains("-") & low.rlike(HYPHENED))

    def template(core: Column, low: Column, before: Column) -> Column:
        name = (core != low) & (F.substring(core, 1, 1) != F.substring(low, 1, 1)) & F.coalesce(before != _END, F.lit(False))
        return F.when(number(low), NUM).when(low.isin(UNITS) & F.coalesce(number(before), F.lit(False)), UNIT) \
            .when(name, NAME).otherwise(low)

    return let(_clean(text), lambda s: let(_split(s), lambda p: let(_split(F.lower(s)), lambda l: make(
        p, l, F.transform(l, lambda low, i: template(F.get(p, i), low, F.get(l, i - 1)))))))


def _goes_on(t: Column, before: Column) -> Column:
    """Whether a token belongs to the run of the token before it."""
    return t.isin(NUM, NAME) & F.coalesce(before == t, F.lit(False))


def tokens(text: Column) -> Column:
    """Array of (raw, t): each word without punctuation and its template token; a run of numbers or
    names is one token.  Runs are formed by joining and splitting, in time linear in the text."""
    marked = _templates(text, lambda p, l, ts: F.filter(F.zip_with(p, ts, lambda x, t: F.struct(x.alias("raw"), t.alias("t"))),
                                                        lambda x: x["t"] != _END))
    joined = let(marked, lambda p: F.array_join(F.transform(p, lambda x, i: F.concat(
        F.when(_goes_on(x["t"], F.get(p, i - 1)["t"]), _ON).otherwise(_NEXT), x["raw"], F.lit(_IS), x["t"])), ""))
    return F.transform(F.filter(F.split(joined, _NEXT), lambda r: r != ""), lambda r: F.struct(
        F.regexp_replace(F.regexp_replace(r, f"{_IS}[^{_ON}{_IS}]*{_ON}", " "), f"{_IS}[^{_IS}]*$", "").alias("raw"),
        F.regexp_extract(r, f"{_IS}([^{_IS}]*)$", 1).alias("t")))


def hashes(text: Column) -> Column:
    """(t, raw): the hashes of the template tokens, and those of the words without punctuation in lower case,
    of unspaced scripts of each character; no hash of one kind is meant to meet the other."""
    def of_templates(ts: Column) -> Column:
        runs = let(F.array_remove(ts, _END), lambda p: F.filter(p, lambda t, i: ~_goes_on(t, F.get(p, i - 1))))
        return F.transform(runs, lambda t: F.xxhash64(t))

    def of_words(lows: Column) -> Column:
        return F.transform(F.array_remove(lows, _END), lambda c: F.xxhash64(c, F.lit("raw")))

    apart = F.regexp_replace(F.regexp_replace(text, f"[{WIDE}]", " "), f"({UNSPACED})", " $1 ")
    return _templates(text, lambda p, l, ts: F.struct(of_templates(ts).alias("t"), of_words(
        F.when(text.rlike(BEYOND) & text.rlike(UNSPACED), _split(F.lower(_clean(apart)))).otherwise(l)).alias("raw")))


def raw_hashes(text: Column) -> Column:
    return hashes(text)["raw"]


def window_hashes(one: Column, size: int) -> Column:
    """Hash of every run of ``size`` tokens, by position, from the tokens' hashes; hashes of runs of
    2^k tokens are built from two of half the length."""

    def widen(h: Column, have: int) -> Column:
        if have == size:
            return F.slice(h, 1, F.greatest(F.size(h) - (size - 1), F.lit(0)))
        step = min(have, size - have)
        wider = F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step)))
        return let(wider, lambda p: widen(p, have + step))

    return let(one, lambda h: widen(h, 1))


def with_row_key(docs: DataFrame) -> DataFrame:
    """One long per row that equal rows share."""
    return docs.withColumn("__k", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"))


def _items(benchmark: DataFrame, made: Column) -> DataFrame:
    """(item_id, item, b, size) of every distinct text that has tokens."""
    items = benchmark.where(F.col("text").isNotNull()).groupBy("text").agg(F.min("item_id").alias("item_id")) \
        .select("item_id", F.xxhash64("text").alias("item"), made.alias("b"))
    return cut_lineage(items.withColumn("size", F.least(F.size("b"), F.lit(WINDOW))).where("size > 0"))


def _sizes(items: DataFrame) -> list[int]:
    return sorted(r["size"] for r in items.select("size").distinct().collect())  # at most WINDOW values


def _windows(items: DataFrame, one: Column, sizes: list[int]) -> DataFrame:
    """(item, size, b, at, h): the windows of every item from its tokens' hashes."""
    parts = [items.where(F.col("size") == s).select("item", F.lit(s).alias("size"), "b", F.posexplode(
        window_hashes(one, s)).alias("at", "h")) for s in sizes]
    found = parts[0] if parts else items.select("item", "size", "b", F.lit(0).alias("at"), F.lit(0).cast("long").alias("h"))
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def _template_windows(items: DataFrame, sizes: list[int]) -> DataFrame:
    def useful(items: DataFrame) -> DataFrame:
        found = _windows(items, F.transform("b", lambda x: F.xxhash64(x["t"])), sizes)
        literal = F.size(F.filter(F.slice("b", F.col("at") + 1, F.col("size")), lambda x: ~x["t"].isin(NUM, UNIT, NAME)))
        return found.where(literal >= MIN_LITERAL).select("item", "size", "at", "h")

    first = F.substring(F.get("b", F.lit(0))["raw"], 1, 1)
    named = items.where((first != F.lower(first)) & (F.get("b", F.lit(0))["t"] != NUM)
                        & F.coalesce(F.get("b", F.lit(1))["t"] != NAME, F.lit(True))).withColumn("b", F.transform(
        "b", lambda x, i: F.struct(x["raw"].alias("raw"), F.when(i == 0, NAME).otherwise(x["t"]).alias("t"))))
    return cut_lineage(useful(items).unionByName(useful(named).where("at = 0")))


def _if_small(keys: DataFrame) -> DataFrame:
    """``keys``, broadcast only if they were counted to be at most ``MAX_BROADCAST``."""
    return F.broadcast(keys) if keys.count() <= MAX_BROADCAST else keys


def _hits(keyed: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """(__k, pos, h, size): where documents have windows of the benchmark.  Template and raw windows of all
    sizes come from one pass over the texts; ``pos`` is a place in the text for template windows only."""
    wanted = cut_lineage(windows.select("h").distinct())
    seen = keyed.select("__k", F.explode(let(hashes(F.col("text")), lambda x: F.array(*[F.struct(
        F.lit(s).alias("size"), F.concat(window_hashes(x["t"], s), window_hashes(x["raw"], s)).alias("all")) for s in sizes]))).alias("x")) \
        .select("__k", "x.size", F.posexplode("x.all").alias("pos", "h"))
    return cut_lineage(seen.join(_if_small(wanted), "h", "left_semi").select("__k", "pos", "h", "size").distinct())


def _verbatim(hits: DataFrame, items: DataFrame, windows: DataFrame) -> DataFrame:
    """(__k, item, item_id, n_windows, share): documents that hold windows of raw tokens of an item."""
    total = windows.groupBy("item").agg(F.count("*").alias("all_windows"))
    found = hits.select("__k", "h", "size").distinct().join(windows, ["h", "size"]).groupBy("__k", "item") \
        .agg(F.countDistinct("at").alias("n_windows"))
    return found.join(total, "item").where(F.col("n_windows") >= MIN_SHARE * F.col("all_windows")) \
        .join(items.select("item", "item_id"), "item") \
        .select("__k", "item", "item_id", "n_windows", (F.col("n_windows") / F.col("all_windows")).alias("share"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(__k, item_id, n_windows, share): every document row key and item it contains; the larger share
    of templates and raw tokens."""
    items, words = _items(benchmark, tokens(F.col("text"))), _items(benchmark, raw_hashes(F.col("text")))
    windows = _template_windows(items, _sizes(items))
    verbatim = cut_lineage(_windows(words, F.col("b"), _sizes(words)).select("item", "size", "at", "h"))
    total = windows.groupBy("item").agg(F.countDistinct("at").alias("all_windows"))
    keyed = with_row_key(docs.select("doc_id", "text"))
    hits = _hits(keyed, windows.select("h", "size").unionByName(verbatim.select("h", "size")), sorted({*_sizes(items), *_sizes(words)}) or [WINDOW])
    aligned = hits.join(windows, ["h", "size"]).groupBy("__k", "item", (F.col("pos") - F.col("at")).alias("shift")) \
        .agg(F.collect_set("at").alias("ats"))  # at most the item's own windows
    likely = cut_lineage(
        aligned.groupBy("__k", "item").agg(F.collect_list(F.struct("shift", "ats")).alias("runs"))
        .join(total, "item").where(
            F.size(F.array_distinct(F.flatten(F.col("runs.ats")))) >= MIN_SHARE * F.col("all_windows")))
    keys = cut_lineage(likely.select("__k").distinct())
    texts = cut_lineage(keyed.join(_if_small(keys), "__k", "left_semi").groupBy("__k").agg(F.first("text").alias("text")))
    both = likely.join(texts.select("__k", tokens(F.col("text")).alias("d")), "__k").join(items.select("item", "item_id", "b", "size"), "item")

    def consistent(run: Column) -> Column:
        """Slots of one alignment map one to one between item and document, and few names changed."""
        places = F.array_distinct(F.flatten(F.transform(run["ats"], lambda a: F.sequence(a, a + F.col("size") - 1))))
        return let(places, lambda where: one_to_one(run, where))

    def one_to_one(run: Column, places: Column) -> Column:
        slots = F.filter(places, lambda p: F.get("d", p + run["shift"])["t"].isin(NUM, UNIT, NAME))
        pairs = F.array_distinct(F.transform(slots, lambda p: F.struct(
            F.get("d", p + run["shift"])["t"].alias("t"), F.get("b", p)["raw"].alias("x"), F.get("d", p + run["shift"])["raw"].alias("y"))))
        return let(pairs, lambda v: (F.size(v) == F.size(F.array_distinct(F.transform(v, lambda s: F.struct(s["t"], s["x"]))))) &
                   (F.size(v) == F.size(F.array_distinct(F.transform(v, lambda s: F.struct(s["t"], s["y"])))))
                   & (F.size(F.filter(v, lambda s: (s["t"] == NAME) & (F.lower(s["x"]) != F.lower(s["y"])))) <= MAX_RENAMED * F.size(places)))

    judged = cut_lineage(both.withColumn("n_windows", F.size(F.array_distinct(F.flatten(
        F.transform(F.filter("runs", consistent), lambda r: r["ats"])))).cast("long"))
        .select("__k", "item", "item_id", "n_windows", (F.col("n_windows") / F.col("all_windows")).alias("share")))
    refuted = judged.where(F.col("share") < MIN_SHARE).select("__k", "item", F.lit(True).alias("refuted"))
    exact = _verbatim(hits, words, verbatim).join(refuted, ["__k", "item"], "left") \
        .where(F.col("refuted").isNull() | (F.col("share") == 1)).drop("refuted")
    return judged.where(F.col("share") >= MIN_SHARE).unionByName(exact).groupBy("__k", "item", "item_id") \
        .agg(F.max(F.struct("share", "n_windows")).alias("x")).select("__k", "item_id", "x.n_windows", "x.share")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated documents."""
    bad = cut_lineage(contaminated(docs, benchmark).select("__k").distinct())
    return with_row_key(docs).join(_if_small(bad), "__k", "left_anti").select(*docs.columns)


@query("op3_template_decontamination")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = contaminated(docs, table(spark, sf_dir, "benchmark"))
    ids = with_row_key(docs.select("doc_id", "text")).select("__k", "doc_id")
    return ids.join(found, "__k").select("doc_id", "item_id", "n_windows", "share", F.lit(True).alias("contaminated"))
