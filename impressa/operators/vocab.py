"""Dense-id dictionaries and text encoding.

Ids are assigned without a single-partition window: ``dense_index`` range-partitions the keys
on their order, numbers rows inside each partition, and adds each partition's offset (one number
per partition).  The numbered table is written first so both uses see the same layout even if an
executor is lost, and so that a small dictionary can be recognised as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from impressa.functions.scalar import pad_right
from impressa.functions.text import DEFAULT_TOKEN_PATTERN, tokenize
from impressa.operators.skew import broadcast_if_small, fits, lookup_join
from impressa.session import stored

LOCAL_BITS = 33  # monotonically_increasing_id = partition id << 33 | row number in partition


def dense_index(df: DataFrame, order: list, id_col: str = "idx", start: int = 1) -> DataFrame:
    """Number the rows of ``df`` 1..n (from ``start``) in ``order`` — distributed and exact.

    ``order`` must be a total order (ties would be numbered arbitrarily)."""
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
    numbered = stored(ranged.withColumn("_mid", F.monotonically_increasing_id()))
    pid = F.shiftrightunsigned("_mid", LOCAL_BITS)
    local = F.col("_mid").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))
    counts = numbered.groupBy(pid.alias("_pid")).agg((F.max(local) + 1).alias("_cnt"))
    # one row per partition, read once: the offsets are one array literal, looked up by partition number,
    # so the plan's size stays known and a row's lookup costs the same however many partitions there are
    offsets, total = [], 0
    for r in counts.orderBy("_pid").collect():
        offsets += [total] * (r["_pid"] + 1 - len(offsets))
        total += r["_cnt"]
    offset = F.split(F.lit(",".join(map(str, offsets or [0]))), ",").cast("array<bigint>")[pid.cast("int")]
    return numbered.withColumn(id_col, (offset + local + F.lit(start)).cast("long")).drop("_mid")


def first_seen_ids(events: DataFrame, key: str, order: list[str], start: int = 1, with_first: bool = False,
                   known: DataFrame | None = None) -> DataFrame:
    """V2/V3: (key, idx) numbering keys by their first appearance in ``order`` (a total order of
    the events).  The per-key minimum is a partial aggregate, so hot keys are cheap.
    ``with_first`` adds the first appearance (a struct of ``order``): if the order starts with the
    split, keys first seen in training are the dictionary as it was before the test split.
    Only keys of ``known`` count; they are looked up once a key, not once an event."""
    first = events.groupBy(F.col(key).alias("key")).agg(F.min(F.struct(*order)).alias("first"))
    if known is not None:
        first = lookup_join(first, known.select(F.col(key).alias("key")).distinct(), ["key"], "left_semi")
    return dense_index(first, ["first"], start=start).select("key", "idx", *(["first"] if with_first else []))


def shared_category_ids(news: DataFrame, row_order: list[str], cols=("category", "subcategory"),
                        with_first: bool = False) -> DataFrame:
    """V4: one id space for category and subcategory; in row order, category before subcategory."""
    pairs = news.select(*row_order, F.explode(F.array(*[
        F.struct(F.col(c).alias("key"), F.lit(i).alias("_field")) for i, c in enumerate(cols)])).alias("x")) \
        .select(*row_order, "x.key", "x._field").where(F.col("key").isNotNull() & (F.col("key") != ""))
    return first_seen_ids(pairs, "key", [*row_order, "_field"], with_first=with_first)


def field_tokens(news: DataFrame, row_order: list[str], fields=("title", "abstract"),
                 pattern: str = DEFAULT_TOKEN_PATTERN) -> DataFrame:
    """V1 long form: (row..., _field, tpos, token) for each text field, whole texts."""
    arr = F.array(*[F.struct(F.lit(i).alias("_field"), tokenize(f, pattern).alias("toks"))
                    for i, f in enumerate(fields)])
    x = news.select(*row_order, F.inline(arr))
    return x.select(*row_order, "_field", F.posexplode("toks").alias("tpos", "token"))


def word_ids(news: DataFrame, vectors: DataFrame, row_order: list[str], fields=("title", "abstract"),
             pattern: str = DEFAULT_TOKEN_PATTERN, tokens: DataFrame | None = None,
             with_first: bool = False) -> DataFrame:
    """V5: ids for tokens that have a vector, by first appearance (title tokens before abstract).
    ``tokens`` may pass an already tokenized (row..., _field, tpos, token) table."""
    toks = tokens if tokens is not None else field_tokens(news, row_order, fields, pattern)
    return first_seen_ids(toks, "token", [*row_order, "_field", "tpos"], with_first=with_first, known=vectors.select("token"))  # J7


def shared_text_word_ids(news: DataFrame, vectors: DataFrame, row_order: list[str], title: str, text_key: str,
                         text_tokens: DataFrame, pattern: str = DEFAULT_TOKEN_PATTERN, with_first: bool = False) -> DataFrame:
    """V5 where articles share texts: ``text_tokens`` (text_key, tpos, token), or (text_key, tokens) as ``token_lists``
    makes it, holds each text once, and only the first article that has a text counts.  Equal to ``word_ids`` on articles
    that carry their own copy of the text.

    The texts' first articles are numbered in row order.  The number and the token's place make one number, so a
    token's least place is kept by hash in every task, and only the tokens that differ in a task leave it."""
    first_article = news.where(F.col(text_key).isNotNull()).groupBy(text_key).agg(F.min(F.struct(*row_order)).alias("_row"))
    numbered = dense_index(first_article, ["_row", text_key], "_at")
    # an article's number is looked up by its text while that is one row, which streams past the numbers of its partition
    number = numbered.select(text_key, "_at")
    number = F.broadcast(number) if fits(number) else number.hint("shuffle_hash")
    own = text_tokens.join(number, text_key)
    if "tokens" in text_tokens.columns:
        own = own.select("_at", F.posexplode("tokens").alias("tpos", "token"))
    least = own.groupBy("token").agg(F.min(F.shiftleft(F.col("_at"), 32) + F.col("tpos")).alias("_least"))
    in_text = least.select("token", F.shiftright("_least", 32).alias("_at"), F.col("_least").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("tpos")) \
        .join(numbered.select("_at", "_row.*"), "_at").select(*row_order, F.lit(1).alias("_field"), "tpos", "token")
    in_title = field_tokens(news, row_order, (title,), pattern)
    return word_ids(news, vectors, row_order, tokens=in_title.unionByName(in_text), with_first=with_first)


def sorted_ids(keys: DataFrame, key: str = "key") -> DataFrame:
    """V6: ids 1..n over the distinct keys in sorted order."""
    d = keys.select(F.col(key).alias("key")).where(F.col("key").isNotNull()).distinct()
    return dense_index(d, ["key"])


def extend_ids(existing: DataFrame, new_keys: DataFrame, order: list[str]) -> DataFrame:
    """V8: add unseen keys after the current maximum id; existing ids never change.

    ``new_keys`` has ``key`` plus the ``order`` columns (one row per key)."""
    fresh = new_keys.join(existing.select("key"), "key", "left_anti")
    top = existing.agg(F.coalesce(F.max("idx"), F.lit(0))).scalar()  # the current maximum id
    numbered = dense_index(fresh, order).select("key", (F.col("idx") + top).cast("long").alias("idx"))
    return existing.select("key", "idx").unionByName(numbered)


def encode_tokens(tokens: DataFrame, rows: DataFrame, word2int: DataFrame, row: str, max_len: int,
                  out: str) -> DataFrame:
    """V7 on a tokenized text table (row, tpos, token): ids of known tokens (unknown ones dropped
    *before* truncation), first ``max_len`` kept, zero-padded behind (P8).  ``rows`` lists every
    row, so a text without any known token gets all zeros."""
    known = lookup_join(tokens.select(row, "tpos", "token"), word2int.select(F.col("key").alias("token"), "idx"),
                        ["token"])
    w = Window.partitionBy(row).orderBy("tpos")
    first = known.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max_len)
    ids = first.groupBy(row).agg(F.array_sort(F.collect_list(F.struct("tpos", "idx"))).alias("_s"))
    ids = ids.select(row, F.transform("_s", lambda s: s["idx"]).alias("_ids"))
    base = rows.select(row).distinct().join(ids, row, "left")
    return base.select(row, pad_right(F.coalesce("_ids", F.array().cast("array<long>")), max_len, 0).alias(out))


def encode_lists(lists: DataFrame, word2int: DataFrame, row: str, max_len: int, out: str) -> DataFrame:
    """V7 on token lists (row, tokens), as ``encode_tokens`` on their long form.

    The ids of a list's first ``2 * max_len`` tokens are looked up first.  Only lists that are longer and have fewer
    than ``max_len`` known tokens there need the rest of theirs, which is then looked up whole."""
    head = 2 * max_len
    d = word2int.select(F.col("key").alias("token"), "idx")

    def known(tokens):
        w = Window.partitionBy(row).orderBy("tpos")
        first = lookup_join(tokens, d, ["token"]).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max_len)
        return first.groupBy(row).agg(F.array_sort(F.collect_list(F.struct("tpos", "idx"))).alias("_s"))

    begun = stored(known(lists.select(row, F.posexplode(F.slice("tokens", 1, head)).alias("tpos", "token"))))
    full = begun.where(F.size("_s") >= max_len).select(row)
    short = stored(lists.where(F.size("tokens") > head).select(row).distinct().join(full, row, "left_anti"))
    tail = lists.where(F.size("tokens") > head).join(broadcast_if_small(short), row, "left_semi") \
        .select(row, F.posexplode(F.slice("tokens", F.lit(head + 1), F.size("tokens"))).alias("tpos", "token"))
    ended = known(tail.withColumn("tpos", F.col("tpos") + head))
    ids = begun.unionByName(ended).groupBy(row).agg(F.slice(F.array_sort(F.flatten(F.collect_list("_s"))), 1, max_len).alias("_s"))
    ids = ids.select(row, F.transform("_s", lambda s: s["idx"]).alias("_ids"))
    base = lists.select(row).distinct().join(ids, row, "left")
    return base.select(row, pad_right(F.coalesce("_ids", F.array().cast("array<long>")), max_len, 0).alias(out))


def encode_text(news: DataFrame, word2int: DataFrame, row: str, field: str, max_len: int,
                pattern: str = DEFAULT_TOKEN_PATTERN, out: str | None = None) -> DataFrame:
    """V7: text -> padded ids of known tokens (see ``encode_tokens``)."""
    toks = news.select(row, F.posexplode(tokenize(field, pattern)).alias("tpos", "token"))
    return encode_tokens(toks, news, word2int, row, max_len, out or f"{field}_ids")


def gather_vectors(word2int: DataFrame, vectors: DataFrame) -> DataFrame:
    """V9: (idx, vec) in vocabulary order with the zero row 0 first."""
    v = word2int.select(F.col("key").alias("token"), "idx").join(vectors, "token").select("idx", "vec")
    dim = F.broadcast(vectors.agg(F.max(F.size("vec")).alias("_dim")))  # one row
    zero = dim.select(F.lit(0).cast("long").alias("idx"),
                      F.array_repeat(F.lit(0.0).cast("float"), F.col("_dim")).alias("vec"))
    return zero.unionByName(v.select(F.col("idx").cast("long"), F.col("vec").cast("array<float>")))


def decode_ids(df: DataFrame, row: str, ids: str, word2int: DataFrame, out: str = "text") -> DataFrame:
    """Id array -> space-joined tokens, padding (0) skipped."""
    x = df.select(row, F.posexplode(ids).alias("p", "idx")).where(F.col("idx") != 0)
    j = lookup_join(x, word2int.select(F.col("key").alias("token"), "idx"), ["idx"])
    g = j.groupBy(row).agg(F.array_sort(F.collect_list(F.struct("p", "token"))).alias("_s"))
    return df.select(row).join(g, row, "left").select(
        row, F.coalesce(F.array_join(F.transform("_s", lambda s: s["token"]), " "), F.lit("")).alias(out))


def lookup_by_index(news2int: DataFrame, news: DataFrame, idx_values: DataFrame) -> DataFrame:
    """Records for dense ids (0 = padding has no record); returns the title as title (Q16)."""
    m = idx_values.where(F.col("idx") != 0).join(news2int, "idx").withColumnRenamed("key", "news_id")
    return m.join(news, "news_id")


def encode_batch(texts: DataFrame, word2int: DataFrame, row: str, field: str,
                 pattern: str = DEFAULT_TOKEN_PATTERN, on_missing: str = "error") -> DataFrame:
    """Encode ad-hoc texts with an existing dictionary, zero-padded to the longest one.

    ``on_missing='error'`` raises when a token is unknown (like the reference); ``'drop'`` skips it."""
    toks = texts.select(row, F.posexplode(tokenize(field, pattern)).alias("tpos", "token"))
    j = toks.join(word2int.select(F.col("key").alias("token"), "idx"), "token", "left")
    known = F.col("idx").isNotNull()
    if on_missing == "error":  # checked row by row, in the same pass
        known = known | F.raise_error(F.concat(F.lit("token missing from the dictionary: "), "token")).cast("boolean")
    j = j.where(known)
    g = j.groupBy(row).agg(F.array_sort(F.collect_list(F.struct("tpos", "idx"))).alias("_s"))
    g = g.select(row, F.transform("_s", lambda s: s["idx"]).alias("ids"))
    longest = g.agg(F.max(F.size("ids"))).scalar()  # the batch's longest text
    return g.select(row, F.concat("ids", F.array_repeat(F.lit(0).cast("long"), longest - F.size("ids"))).alias("ids"))


def tokens_long(df: DataFrame, row: str, field: str, pattern: str = DEFAULT_TOKEN_PATTERN) -> DataFrame:
    """V1 long form for one field: (row, tpos, token)."""
    return df.select(row, F.posexplode(tokenize(field, pattern)).alias("tpos", "token"))


def token_lists(df: DataFrame, row: str, field: str, pattern: str = DEFAULT_TOKEN_PATTERN) -> DataFrame:
    """V1 for one field: (row, tokens), a list for every text.  Written once for all that reads it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.select(row, field).repartition(n).select(row, tokenize(field, pattern).alias("tokens")))
