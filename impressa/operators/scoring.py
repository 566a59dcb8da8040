"""Distributed batch scoring with supplied vectors and weights.

The catalogue is encoded once (not once per impression), then scores are joins plus dot
products.  What depends on the item only (its vector, its attention logit) is computed per item
before the join.  Vectors travel as arrays; pooling reads a whole Arrow batch of groups as one
matrix and reduces it by group offsets.  Model weights are small fixed matrices; kernels that
Spark cannot express (self-attention, CNN, GRU) are caller functions that ``mapInArrow`` calls
once per batch on a padded (batch, length, dim) array.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from impressa.functions.scalar import dot, relu
from impressa.operators.skew import in_waves, lookup_join, waves
from impressa.session import stored


# Fixed value: a token's vectors are broadcast up to this size.
VECTOR_BYTES = 64 << 20
LISTS_AT_ONCE = 1024  # lists of readers that are pooled together


def _lit_vec(v: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def _stack(series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in series]) if len(series) else np.zeros((0, 0))


def linear(x, weight, bias=None) -> Column:
    """W x + b for an array column and a small fixed matrix (rows = outputs), evaluated on Arrow
    batches with one matrix product per batch."""
    w = np.asarray(weight, dtype=np.float64)
    b = np.zeros(w.shape[0]) if bias is None else np.asarray(bias, dtype=np.float64)

    @F.pandas_udf("array<double>")
    def _linear(v: pd.Series) -> pd.Series:
        if len(v) == 0:
            return pd.Series([], dtype=object)
        return pd.Series(list(_stack(v) @ w.T + b))

    return _linear(F.col(x) if isinstance(x, str) else x)


def embed_tokens(token_ids: DataFrame, weights: DataFrame, idx: str = "idx") -> DataFrame:
    """B1: long token ids -> vectors; id 0 (padding) gets the zero row of ``weights`` (idx, vec)."""
    return lookup_join(token_ids, weights.select(F.col("idx").alias(idx), "vec"), [idx], "inner", VECTOR_BYTES)


def attention_logit(x, weight, bias, query) -> Column:
    """q . tanh(W x + b) per row (B2's score), one matrix product per Arrow batch."""
    w = np.asarray(weight, dtype=np.float64)
    b = np.asarray(bias, dtype=np.float64)
    q = np.asarray(query, dtype=np.float64)

    @F.pandas_udf("double")
    def _logit(v: pd.Series) -> pd.Series:
        if len(v) == 0:
            return pd.Series([], dtype=np.float64)
        return pd.Series(np.tanh(_stack(v) @ w.T + b) @ q)

    return _logit(F.col(x) if isinstance(x, str) else x)


def _grouped(column: pa.ListArray):
    """(offsets, fields) of a list<struct> batch column: flat numpy arrays, vectors as a matrix."""
    offsets = np.asarray(column.offsets).astype(np.int64)
    flat = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    fields = {}
    for i in range(flat.type.num_fields):
        x = flat.field(i)
        if pa.types.is_list(x.type) or pa.types.is_large_list(x.type):
            values = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            fields[flat.type.field(i).name] = values.reshape(len(x), -1) if len(x) else np.zeros((0, 0))
        else:
            fields[flat.type.field(i).name] = x.to_numpy(zero_copy_only=False)
    return offsets - offsets[0], fields


def _vectors(matrix: np.ndarray) -> pa.ListArray:
    n, d = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), pa.array(matrix.ravel(), pa.float64()))


def _runs(groups: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row order, start of each run in it, the runs' group values); nulls are one group."""
    if isinstance(groups, pa.ChunkedArray):
        groups = groups.combine_chunks()
    coded = pc.dictionary_encode(groups, null_encoding="encode")
    codes = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    start = np.flatnonzero(np.concatenate([[True], np.diff(codes[order]) != 0]))
    return order, start, coded.dictionary.take(pa.array(codes[order][start]))


def _combined(order, start, top, total, n, acc):
    """States (largest logit, sum of exp(logit - largest), rows, weighted vector) of equal groups, combined."""
    top, total, n, acc = top[order], total[order], n[order], acc[order]
    size = np.diff(np.append(start, len(order)))
    new = np.maximum.reduceat(top, start)
    scale = np.exp(top - np.repeat(new, size))
    return new, np.add.reduceat(total * scale, start), np.add.reduceat(n, start), np.add.reduceat(acc * scale[:, None], start, axis=0)


def _matrix(column) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _pool(items: DataFrame, group: str, vec: str, weight: Column, kind: str, out: str, pad_to: int | None = None,
          pad_logit: float = 0.0) -> DataFrame:
    """Weighted sum of the vectors of each group.  ``kind``: 'softmax' of the weights (logits), 'mean', or
    'sum' as they are.

    A group is never gathered: every Arrow batch is reduced to one mergeable state per group before the
    shuffle, and behind it the states, sorted by group, are folded into one as they stream by."""
    rows = items.select(F.col(group).alias("g"), weight.cast("double").alias("w"), F.col(vec).cast("array<double>").alias("v"))
    state = T.StructType([rows.schema["g"], T.StructField("top", T.DoubleType()), T.StructField("total", T.DoubleType()),
                          T.StructField("n", T.LongType()), T.StructField("acc", T.ArrayType(T.DoubleType()))])
    result = T.StructType([T.StructField(group, rows.schema["g"].dataType), T.StructField(out, T.ArrayType(T.DoubleType()))])

    def partial(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            order, start, groups = _runs(batch.column("g"))
            w, v = batch.column("w").to_numpy(zero_copy_only=False), _matrix(batch.column("v"))
            one = np.ones(len(w))
            if kind != "softmax":  # the same state with equal logits: a plain weighted sum and a count
                w, v = np.zeros(len(w)), v if kind == "mean" else v * w[:, None]
            top, total, n, acc = _combined(order, start, w, one, one, v)
            yield pa.RecordBatch.from_arrays([groups, pa.array(top), pa.array(total), pa.array(n.astype(np.int64)), _vectors(acc)],
                                             names=["g", "top", "total", "n", "acc"])

    def finished(groups, top, total, n, acc):
        if kind == "softmax":
            spare = np.maximum((pad_to or 0) - n, 0)  # padding rows: zero vectors that share the weight
            new = np.where(spare > 0, np.maximum(top, pad_logit), top)
            total, acc = total * np.exp(top - new) + spare * np.exp(pad_logit - new), acc * np.exp(top - new)[:, None]
        if kind != "sum":
            acc = acc / total[:, None]
        return pa.RecordBatch.from_arrays([groups, _vectors(acc)], names=[group, out])

    def merge(batches):
        held = None  # the last group's state: the next batch may go on with it
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column("g")
            state = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("top", "total", "n")] + [_matrix(batch.column("acc"))]
            if held is not None:
                groups = pa.concat_arrays([held[0], groups])
                state = [np.concatenate([a, b]) for a, b in zip(held[1], state)]
            order, start, groups = _runs(groups)
            state = list(_combined(order, start, *state))
            last = len(groups) - 1
            held = (groups.slice(last), [x[last:] for x in state])
            if last:
                yield finished(groups.slice(0, last), *[x[:last] for x in state])
        if held is not None:
            yield finished(held[0], *held[1])

    return rows.mapInArrow(partial, state).repartition("g").sortWithinPartitions("g").mapInArrow(merge, result)


def _pool_shared(lines: DataFrame, items: DataFrame, kind: str, out: str, tasks: int | None = None,
                 pad_to: int | None = None, pad_logit: float = 0.0, cands: DataFrame | None = None) -> DataFrame:
    """``_pool`` over the lists of ``lines`` (reader, imp_id, news_id rows), whose lists overlap within a reader:
    every item of ``items`` (news_id, vec, w) is sent once to each reader that has it, however many of the reader's
    lists hold it.  A reader's items come first, then its lists; behind the shuffle only the items of the reader at
    hand are held.

    With ``cands`` (reader, imp_id, news_id and others) the result is their rows without the reader, with the dot product
    of the candidate's vector and its impression's pooled one as ``score``, 0 where there is none: neither of them
    travels a second time.  Rows without a news_id get the pooled vector itself, null where there is none."""
    vec, id_type, imp_type = items.schema["vec"].dataType, lines.schema["news_id"].dataType, lines.schema["imp_id"].dataType
    own = [c for c in cands.columns if c not in ("reader", "imp_id")] if cands is not None else []
    scoring, carrying = "news_id" in own, cands is not None
    pairs = lines.select("reader", "news_id").distinct()
    if cands is None:
        lists = lines.groupBy("reader", "imp_id").agg(F.collect_list("news_id").alias("list"))
    else:
        if scoring:
            pairs = pairs.unionByName(cands.select("reader", "news_id").distinct()).distinct()
        both = lines.select("reader", "imp_id", "news_id").unionByName(
            cands.select("reader", "imp_id", F.struct(*own).alias("_c")), allowMissingColumns=True)
        lists = both.groupBy("reader", "imp_id").agg(F.collect_list("news_id").alias("list"), F.collect_list("_c").alias("cands"))
    sent = lookup_join(pairs, items, ["news_id"])
    rows = sent.select("reader", F.lit(0).alias("k"), "news_id", F.col("w").cast("double").alias("w"), "vec") \
        .unionByName(lists.withColumn("k", F.lit(1)), allowMissingColumns=True)
    rows = (rows.repartition(tasks, "reader") if tasks else rows.repartition("reader")).sortWithinPartitions("reader", "k")
    added = T.StructField("score", T.DoubleType()) if scoring else T.StructField(out, T.ArrayType(T.DoubleType()))
    result = T.StructType([T.StructField("imp_id", imp_type), *[T.StructField(c, cands.schema[c].dataType) for c in own], added])

    def pooled(w, v, row, pick):
        """(list of each pooled vector, the vectors)."""
        if not len(row):
            return row, np.zeros((0, v.shape[1]))
        start = np.flatnonzero(np.concatenate([[True], np.diff(row) != 0]))
        count = np.diff(np.append(start, len(row)))
        if kind == "softmax":
            top = np.maximum.reduceat(w[pick], start)
            spare = np.maximum((pad_to or 0) - count, 0)  # padding rows: zero vectors that share the weight
            top = np.where(spare > 0, np.maximum(top, pad_logit), top)
            share = np.exp(w[pick] - np.repeat(top, count))
            total = np.add.reduceat(share, start) + spare * np.exp(pad_logit - top)
        else:
            share, total = np.ones(len(row)), count
        return row[start], np.add.reduceat(v[pick] * share[:, None], start, axis=0) / total[:, None]

    def run(batches):
        held = None  # (reader, items, weights, vectors) of the last reader: the next batch may go on with it
        for batch in batches:
            if not batch.num_rows:
                continue
            reader = pc.dictionary_encode(batch.column("reader"), null_encoding="encode")
            names, at = reader.dictionary, reader.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            item = batch.column("k").to_numpy(zero_copy_only=False) == 0
            mask = pa.array(item)
            ids = batch.column("news_id").filter(mask)
            owner, w = at[item], batch.column("w").filter(mask).to_numpy(zero_copy_only=False)
            v = _matrix(batch.column("vec").filter(mask)) if item.any() else None
            if held is not None and held[0] == names[0]:
                ids, owner = pa.concat_arrays([held[1], ids]), np.concatenate([np.zeros(len(held[1]), np.int64), owner])
                w, v = np.concatenate([held[2], w]), held[3] if v is None else np.concatenate([held[3], v])
            v = np.zeros((0, 1)) if v is None else v
            last = owner == at[-1]
            held = (names[int(at[-1])], ids.filter(pa.array(last)), w[last], v[last]) if last.any() else None
            if item.all() or (not carrying and not len(ids)):
                continue
            mask = pa.array(~item)
            texts, at = batch.filter(mask), at[~item]
            lists = texts.column("list")
            offered = texts.column("cands") if carrying else None
            shown = offered.flatten() if carrying else None  # the candidates' rows
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            n_shown = pc.list_value_length(offered).to_numpy(zero_copy_only=False).astype(np.int64) if carrying else np.zeros(len(size), np.int64)
            known = [ids, lists.flatten(), *([shown.field("news_id")] if scoring else [])]
            coded = pc.dictionary_encode(pa.concat_arrays(known), null_encoding="encode")
            code, width = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
            key = owner * width + code[:len(ids)]
            order = np.argsort(key, kind="stable")
            key = key[order]
            code = code[len(ids):]

            def found(who, wanted):
                """Of each wanted item: how many rows it has, and these; 0: no vector; over 1: the catalogue has it more than once."""
                wanted = who * width + wanted
                first = np.searchsorted(key, wanted, "left")
                n = np.searchsorted(key, wanted, "right") - first
                return n, order[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]

            ends, shown_ends = (np.concatenate([[0], np.cumsum(x)]) for x in (size, n_shown))
            for lo in range(0, len(size), LISTS_AT_ONCE):
                hi = min(lo + LISTS_AT_ONCE, len(size))
                line = np.repeat(np.arange(lo, hi), size[lo:hi])
                n, pick = found(at[line], code[ends[lo]:ends[hi]])
                which, mean = pooled(w, v, np.repeat(line, n), pick)
                if not carrying:
                    if len(which):
                        yield pa.RecordBatch.from_arrays([texts.column("imp_id").take(pa.array(which)), _vectors(mean)], names=["imp_id", out])
                    continue
                line = np.repeat(np.arange(lo, hi), n_shown[lo:hi])
                user = np.full(hi - lo, -1)
                user[which - lo] = np.arange(len(which))
                if not scoring:
                    mine, user = shown.slice(shown_ends[lo], len(line)), user[line - lo]
                    yield pa.RecordBatch.from_arrays(
                        [texts.column("imp_id").take(pa.array(line)), *[mine.field(c) for c in own],
                         _vectors(mean).take(pa.array(user, mask=user < 0))], names=["imp_id", *own, out])
                    continue
                n, pick = found(at[line], code[ends[-1] + shown_ends[lo]:ends[-1] + shown_ends[hi]])
                row = np.repeat(np.arange(len(line)), np.maximum(n, 1))  # a candidate without a vector keeps its row
                user, score, hit = user[line[row] - lo], np.zeros(len(row)), np.repeat(n > 0, np.maximum(n, 1))
                both = hit & (user >= 0)
                score[both] = np.einsum("ij,ij->i", v[pick][user[hit] >= 0], mean[user[both]])
                mine = shown.take(pa.array(shown_ends[lo] + row))
                yield pa.RecordBatch.from_arrays([texts.column("imp_id").take(pa.array(line[row])), *[mine.field(c) for c in own], pa.array(score)],
                                                 names=["imp_id", *own, "score"])

    return rows.mapInArrow(run, result)


def attention_pool(items: DataFrame, group: str, vec: str, weight, bias, query, out: str = "vec",
                   logit: str | None = None, mask_padding: bool = True, pad_to: int | None = None) -> DataFrame:
    """B2: additive-attention pooling inside each group: alpha = softmax(q . tanh(W x + b)),
    pooled = sum(alpha x).  Groups may have any size (see ``_pool``).

    ``logit`` names a column that already holds the logits (they depend on the item only, so callers
    that pool the same items many times compute them once).  With ``mask_padding=False`` groups
    are padded to ``pad_to`` zero vectors that take part in the softmax (Q20)."""
    if not mask_padding and pad_to is None:
        raise ValueError("mask_padding=False needs pad_to")
    logits = F.col(logit) if logit else attention_logit(vec, weight, bias, query)
    zero = _padding_logit(bias, query)
    return _pool(items.withColumn("_logit", logits), group, vec, F.col("_logit"), "softmax", out,
                 None if mask_padding else pad_to, zero)


def weighted_sum(items: DataFrame, group: str, vec: str, weight: str, out: str = "vec") -> DataFrame:
    """sum_i w_i x_i per group."""
    return _pool(items, group, vec, F.col(weight), "sum", out)


def mean_pool(items: DataFrame, group: str, vec: str, out: str = "vec") -> DataFrame:
    """Plain mean of the vectors of a group."""
    return _pool(items, group, vec, F.lit(1.0), "mean", out)


def _first(items: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each group; a task drops the others before the shuffle."""
    w = Window.partitionBy(group).orderBy(order)
    return items.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def encode_sequences(items: DataFrame, group: str, order: str, vec: str, kernel: Callable, dim_out: int, out: str = "vec",
                     max_len: int | None = None, state: DataFrame | None = None) -> DataFrame:
    """Caller kernels over each group's vectors in ``order`` (B3, B8, B9).  ``kernel`` is called once
    per Arrow batch with a zero-padded (batch, length, dim) array and a (batch, length) mask
    of real rows and returns (batch, dim_out).  ``max_len`` keeps the first items of a group (as
    P8).  ``state`` (group, state vector) is passed as a third argument, a recurrent kernel's
    initial state."""
    if max_len is not None:
        items = _first(items, group, order, max_len)
    g = items.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(vec).alias("v")))).alias("_xs"))
    if state is not None:
        s_col = next(c for c in state.columns if c != group)
        g = g.join(state.select(group, F.col(s_col).alias("_state")), group)
    schema = T.StructType([g.schema[group], T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            offsets, x = _grouped(batch.column("_xs"))
            size = np.diff(offsets)
            row = np.repeat(np.arange(len(size)), size)
            at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], size)
            padded = np.zeros((len(size), int(size.max()), x["v"].shape[1]))
            mask = np.zeros(padded.shape[:2], bool)
            padded[row, at], mask[row, at] = x["v"], True
            args = [padded, mask]
            if "_state" in batch.schema.names:
                flat = batch.column("_state").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                args.append(flat.reshape(len(size), -1))
            result = np.asarray(kernel(*args), dtype=np.float64).reshape(len(size), dim_out)
            yield pa.RecordBatch.from_arrays([batch.column(group), _vectors(result)], names=[group, out])

    return g.mapInArrow(run, schema)


def encode_catalogue(news_tokens: DataFrame, weights: DataFrame, kernel: Callable, dim_out: int, key: str = "news_id",
                     max_len: int | None = None, kept: bool = False) -> DataFrame:
    """Encode every item once.  Token vectors are gathered by a join (B1) and grouped per
    item, the first ``max_len`` known ones kept (P8) before vectors are attached; ``kernel`` sees a batch
    of items at a time (see ``encode_sequences``).  ``news_tokens`` is (key, tpos, idx).  ``weights`` are stored, so that
    their size is known: tokens are shuffled to a table only if it is large; ``kept`` says that they already are."""
    weights = weights if kept else stored(weights)
    if max_len is not None:
        known = lookup_join(news_tokens.select(key, "tpos", "idx"), weights.select("idx"), ["idx"], "left_semi")
        news_tokens = _first(known, key, "tpos", max_len)
    return encode_sequences(embed_tokens(news_tokens, weights), key, "tpos", "vec", kernel, dim_out)


def category_vectors(cat_emb: DataFrame, weight, bias) -> DataFrame:
    """relu(W e + b) per category id; ``cat_emb`` is (category, vec)."""
    return cat_emb.select("category", F.transform(linear("vec", weight, bias), lambda v: relu(v)).alias("vec"))


def fuse_views(views: DataFrame, weight, bias, query, key: str = "news_id") -> DataFrame:
    """Multi-view fusion — (key, view, vec) rows pooled by attention over the views."""
    return attention_pool(views, key, "vec", weight, bias, query)


def sentiment_aware(news_vecs: DataFrame, senti: str, weight, bias=None) -> DataFrame:
    """linear([vec, s]) per item."""
    x = F.concat(F.col("vec").cast("array<double>"), F.array(F.col(senti).cast("double")))
    return news_vecs.withColumn("vec", linear(x, weight, bias))


def predict_sentiment(news_vecs: DataFrame, weight: Sequence[float], bias: float = 0.0) -> DataFrame:
    """s_hat = w . vec + b."""
    return news_vecs.withColumn("s_hat", dot("vec", _lit_vec(weight)) + F.lit(float(bias)))


def _padding_logit(bias, query) -> float:
    return float(np.tanh(np.asarray(bias, dtype=np.float64)) @ np.asarray(query, dtype=np.float64))


def _shared(history: DataFrame, vecs: DataFrame, weight, bias, query, pad_to: int | None, tasks: int | None,
            cands: DataFrame | None = None) -> DataFrame:
    """``_pool_shared`` with the items' logits (none: the mean), in waves of readers."""
    kind, zero = ("mean", 0.0) if weight is None else ("softmax", _padding_logit(bias, query))
    items = vecs.withColumn("w", F.lit(1.0) if weight is None else attention_logit("vec", weight, bias, query))
    items = stored(items) if waves(tasks) > 1 else items
    return in_waves(lambda part, n: _pool_shared(part(history), items, kind, "user_vec", n, None if weight is None else pad_to, zero,
                                                 None if cands is None else part(cands)), "reader", tasks)


def user_vectors(history: DataFrame, news_vecs: DataFrame, weight=None, bias=None, query=None,
                 max_history: int | None = None, mask_padding: bool = True, kernel: Callable | None = None,
                 dim_out: int | None = None, tasks: int | None = None) -> DataFrame:
    """(imp_id, user_vec) over the first ``max_history`` history items: attention pooling, the
    mean without weights, or a caller's ``kernel`` on the padded sequence.  The attention logit
    is computed once per catalogue item, before the join.

    If ``history`` has a ``reader``, the same for all rows of an impression, an item's vector is sent once to
    each reader instead of once to each impression that has the item; ``tasks`` then deal the readers."""
    h = history if max_history is None else history.where(F.col("hpos") <= max_history)
    vecs = news_vecs.select("news_id", "vec")
    if kernel is not None:
        items = lookup_join(h.select("imp_id", "hpos", "news_id"), vecs, ["news_id"])
        return encode_sequences(items, "imp_id", "hpos", "vec", kernel, dim_out, "user_vec")
    shared = "reader" in history.columns
    if shared:
        if weight is not None and not mask_padding and max_history is None:
            raise ValueError("mask_padding=False needs max_history")
        return _shared(h, vecs, weight, bias, query, None if mask_padding else max_history, tasks)
    if weight is None:
        return mean_pool(lookup_join(h.select("imp_id", "news_id"), vecs, ["news_id"]), "imp_id", "vec", "user_vec")
    vecs = vecs.withColumn("_l", attention_logit("vec", weight, bias, query))
    items = lookup_join(h.select("imp_id", "news_id"), vecs, ["news_id"])
    return attention_pool(items, "imp_id", "vec", weight, bias, query, out="user_vec", logit="_l",
                          mask_padding=mask_padding, pad_to=max_history)


def long_term_users(imps: DataFrame, user_emb: DataFrame, recent: DataFrame | None, mode: str = "con",
                    sequences: DataFrame | None = None, kernel: Callable | None = None, dim_out: int | None = None,
                    history: DataFrame | None = None, news_vecs: DataFrame | None = None, max_history: int | None = None,
                    tasks: int | None = None) -> DataFrame:
    """Long-term user vector (unknown user 0 -> zeros) with the recent-history vector:
    ``'con'`` concatenates them; ``'ini'`` gives the long-term vector as a recurrent kernel's
    initial state.  With ``kernel``, 'ini' runs it over ``sequences`` (imp_id, hpos, vec).

    Without ``recent`` the recent vectors are the means over ``history`` and ``news_vecs`` (see ``user_vectors``) and are
    made where the impressions are, in waves of readers: ``imps`` and ``history`` have a ``reader`` and should be stored."""
    dim = user_emb.agg(F.coalesce(F.max(F.size("vec")), F.lit(0))).scalar()
    shared = ["reader"] if recent is None else []
    j = imps.select(*shared, "imp_id", "user").join(user_emb.select(F.col("user"), F.col("vec").alias("_u")), "user", "left")
    if recent is None:
        h = history if max_history is None else history.where(F.col("hpos") <= max_history)
        # the vectors' width, from the items that any history has
        rdim = lookup_join(h.select("news_id").distinct(), news_vecs.select("news_id", F.size("vec").alias("_size")), ["news_id"]) \
            .agg(F.coalesce(F.max("_size"), F.lit(0))).scalar()
        j = _shared(h, news_vecs.select("news_id", "vec"), None, None, None, None, tasks,
                    stored(j.select("reader", "imp_id", "user", "_u")) if waves(tasks) > 1 else j)
    else:
        rdim = recent.agg(F.coalesce(F.max(F.size("user_vec")), F.lit(0))).scalar()
        j = j.join(recent, "imp_id", "left")
    j = j.withColumn("long_vec", F.coalesce(F.col("_u").cast("array<double>"), F.array_repeat(F.lit(0.0), dim)))
    # no recent history -> zero recent vector of the same width
    j = j.withColumn("user_vec", F.coalesce(F.col("user_vec").cast("array<double>"), F.array_repeat(F.lit(0.0), rdim)))
    if mode == "con":
        return j.select("imp_id", F.concat("long_vec", F.col("user_vec").cast("array<double>")).alias("user_vec"))
    if kernel is None:
        return j.select("imp_id", F.col("long_vec").alias("init_state"), "user_vec")
    return encode_sequences(sequences, "imp_id", "hpos", "vec", kernel, dim_out, "user_vec",
                            state=j.select("imp_id", "long_vec"))


def score_candidates(cands: DataFrame, news_vecs: DataFrame, users: DataFrame) -> DataFrame:
    """score = <candidate vector, user vector> for every candidate; both lookups are joins."""
    c = lookup_join(cands, news_vecs.select("news_id", F.col("vec").alias("_cv")), ["news_id"], "left")
    c = c.join(users.select("imp_id", "user_vec"), "imp_id", "left")
    return c.withColumn("score", F.coalesce(dot("_cv", "user_vec"), F.lit(0.0))).drop("_cv", "user_vec")


def score_shared(cands: DataFrame, history: DataFrame, news_vecs: DataFrame, weight=None, bias=None, query=None,
                 max_history: int | None = None, tasks: int | None = None) -> DataFrame:
    """B8 and B10 in one pass: ``score_candidates`` of ``cands`` with the ``user_vectors`` of ``history`` (attention
    pooling, or the mean without weights).  Both have a ``reader``, the same for all rows of an impression; an item's vector is
    sent once to each reader, for history and candidates together, and user vectors never leave their task.  Readers
    come in waves (see ``in_waves``), so ``cands`` and ``history`` should be stored."""
    h = history if max_history is None else history.where(F.col("hpos") <= max_history)
    return _shared(h, news_vecs.select("news_id", "vec"), weight, bias, query, None, tasks, cands)


def fit_click_model(train: DataFrame, feature_cols: list[str], label: str = "label", max_iter: int = 50):
    """B12 (re-aimed training): a logistic click model on candidate features with Spark ML."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    va = VectorAssembler(inputCols=feature_cols, outputCol="_features", handleInvalid="keep")
    lr = LogisticRegression(featuresCol="_features", labelCol=label, maxIter=max_iter, regParam=0.01)
    model = lr.fit(va.transform(train.withColumn(label, F.col(label).cast("double"))))
    return va, model


def _listwise_sums(weights: np.ndarray, apply_sigmoid: bool):
    """Loss, gradient and Hessian of a partition's rows, as one array."""
    d = len(weights)

    def run(batches):
        out = np.zeros(2 + d + d * d)
        for batch in batches:
            if not batch.num_rows:
                continue
            size = np.diff(np.asarray(batch.column("_x").offsets).astype(np.int64))
            flat = batch.column("_x").flatten()
            x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
            start = np.concatenate([[0], np.cumsum(size)[:-1]])
            row = np.repeat(np.arange(len(size)), size)
            z = x @ weights
            y = 1 / (1 + np.exp(-z)) if apply_sigmoid else z
            slope = y * (1 - y) if apply_sigmoid else np.ones(len(z))
            top = np.maximum.reduceat(y, start)
            e = np.exp(y - top[row])
            p = e / np.add.reduceat(e, start)[row]
            jac = slope[:, None] * x
            mean = np.add.reduceat(p[:, None] * jac, start, axis=0)
            out[0] += len(size)
            out[1] += (np.log(np.add.reduceat(e, start)) + top - y[start]).sum()
            out[2:2 + d] += mean.sum(axis=0) - jac[start].sum(axis=0)
            bend = p.copy()  # what the sigmoid's own curvature adds
            bend[start] -= 1.0
            bend *= slope * (1 - 2 * y) if apply_sigmoid else 0.0
            out[2 + d:] += ((p[:, None] * jac).T @ jac - mean.T @ mean + (bend[:, None] * x).T @ x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], names=["sums"])
    return run


def listwise_objective(rows: DataFrame, weights, apply_sigmoid: bool = True) -> tuple[float, np.ndarray, np.ndarray]:
    """(loss, gradient, Hessian) of F8's mean cross-entropy at ``weights``.  ``rows`` has ``_x``, an array of
    feature arrays with the click first.  One pass; sums add up in Spark, and d * d + d + 2 numbers arrive."""
    w = np.asarray(weights, dtype=np.float64)
    d = len(w)
    sums = rows.select("_x").mapInArrow(_listwise_sums(w, apply_sigmoid), "sums array<double>") \
        .select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(2 + d + d * d)
    for r in sums:
        total[r["i"]] = r["v"]
    n = max(total[0], 1.0)
    return total[1] / n, total[2:2 + d] / n, total[2 + d:].reshape(d, d) / n


def listwise_rows(slots: DataFrame, feature_cols: list[str], row: Sequence[str], slot: str = "slot") -> DataFrame:
    """(row..., _x): the feature arrays of a training row's slots in slot order, the click (slot 0) first.
    A group is one training row, a click and its drawn negatives."""
    x = F.array(*[F.col(c).cast("double") for c in feature_cols])
    return slots.groupBy(*row).agg(F.array_sort(F.collect_list(F.struct(slot, x.alias("x")))).alias("_s")) \
        .where(F.col("_s")[0][slot] == 0).select(*row, F.transform("_s", lambda s: s["x"]).alias("_x"))


def fit_listwise(rows: DataFrame, dim: int, apply_sigmoid: bool = True, max_iter: int = 50, tolerance: float = 1e-8):
    """B12, listwise: weights that minimise the mean cross-entropy between each click and its negatives (F8), by
    damped Newton steps (along directions of negative curvature with its sign turned).  Every step is one pass over the stored ``rows`` (see ``listwise_rows``).

    Returns (weights, loss, gradient).  Without rows all weights are 0."""
    rows = stored(rows.select("_x"))
    w, damping = np.zeros(dim), 1e-6
    loss, grad, curve = listwise_objective(rows, w, apply_sigmoid)
    for _ in range(max_iter):
        if np.abs(grad).max(initial=0.0) <= tolerance:
            break
        bent, axes = np.linalg.eigh(curve)
        bent = np.maximum(np.abs(bent), 1e-12)
        step = axes @ (axes.T @ -grad / (bent + damping * bent.max()))
        new = listwise_objective(rows, w + step, apply_sigmoid)
        if new[0] <= loss + 1e-15:
            w, (loss, grad, curve), damping = w + step, new, max(damping / 10, 1e-9)
        elif damping > 1e9:
            break
        else:
            damping = max(damping * 10, 1e-4)
    return w, loss, grad


def apply_click_model(df: DataFrame, va, model) -> DataFrame:
    """B12 scoring: click probability of the positive class as ``score``."""
    from pyspark.ml.functions import vector_to_array
    out = model.transform(va.transform(df))
    return out.withColumn("score", vector_to_array("probability").getItem(1)) \
        .drop("_features", "rawPrediction", "probability", "prediction")
