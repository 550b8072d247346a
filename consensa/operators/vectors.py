"""Term vectors kept as long rows ``(doc, term, value)`` (never densified), TF-IDF,
class-based TF-IDF, and dense-vector helpers (validation, normalisation, hybrid concat,
truncated SVD)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from consensa.functions.text import gram_strings
from consensa.session import cut_lineage

#: Bits of the map by which ``_without`` tells rows apart, 64 in a row of it.
MAP_BITS = 1 << 24
#: Tokens of a block of documents whose n-grams are counted together.
BLOCK_TOKENS = 1_000_000


def l2_normalize(v: Column) -> Column:
    """Unit-length copy of an ``array<double>`` (zero vectors stay zero)."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(F.arrays_zip(v.alias("x"), F.array_repeat(norm, F.size(v)).alias("n")),
                       lambda e: F.when(e["n"] > 0, e["x"] / e["n"]).otherwise(e["x"]))


def load_embeddings(df: DataFrame, vec_col: str, dim: int, normalize: bool = True) -> DataFrame:
    """Dense vectors as ``array<double>``: a row of another dimension fails the query, values
    are cast to double and optionally L2-normalised."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    wrong = F.raise_error(F.concat(F.lit(f"a vector has not {dim} dimensions but "), F.size(vec_col).cast("string")))
    out = df.withColumn(vec_col, F.when(F.size(vec_col) == dim, v).otherwise(wrong))
    if normalize:
        out = out.withColumn(vec_col, l2_normalize(F.col(vec_col)))
    return out


def hybrid_vector(a: Column, b: Column) -> Column:
    """``normalize(concat(normalize(a), normalize(b)))``."""
    return l2_normalize(F.concat(l2_normalize(a), l2_normalize(b)))


def _dealt(docs: DataFrame, id_col: str, tokens_col: str, blocks: int) -> DataFrame:
    """``(block, doc, text, sizes)``: documents dealt into blocks by a hash of their id, their tokens as one text and the
    bytes of each (-1: null), which is about the text's own size in a shuffle."""
    tok = F.col(tokens_col)
    return docs.select(
        F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("block"), F.col(id_col).alias("doc"),
        F.coalesce(F.array_join(tok, ""), F.lit("")).alias("text"),
        F.coalesce(F.transform(tok, lambda t: F.coalesce(F.octet_length(t), F.lit(-1))), F.array().cast("array<int>")).alias("sizes"))


def _string_array(data, offsets, null=None):
    """An Arrow string array over ``data``'s bytes from ``offsets`` on."""
    import pyarrow as pa
    valid = None if null is None or not null.any() else pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [valid, pa.py_buffer(np.asarray(offsets, np.int64)), data])


def _buffers(strings):
    """The bytes of an Arrow string array, and where each string begins in them (and the last one ends)."""
    if not len(strings):
        return b"", np.zeros(1, np.int64)
    at = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset:strings.offset + len(strings) + 1]
    return memoryview(strings.buffers()[2])[at[0]:at[-1]] if at[-1] > at[0] else b"", at - at[0]


def _block_counts(table, n_min: int, n_max: int, buckets: int):
    """Of a block's documents: ``(docs, terms, bucket, doc, term, n)``.  ``docs`` are the distinct ids, ``terms`` the distinct n-grams
    in the order of their ``bucket`` (by hash) and text; the last three are the counts, by numbers of document and term."""
    import pandas as pd
    import pyarrow as pa
    import pyarrow.compute as pc
    table = table.combine_chunks()
    ids = table["doc"].combine_chunks().dictionary_encode(null_encoding="encode")
    lists = table["sizes"].combine_chunks()
    sizes = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    tokens = _string_array(pa.py_buffer("".join(table["text"].to_pylist()).encode()), np.append(0, np.cumsum(np.maximum(sizes, 0))), sizes < 0)
    tokens = tokens.dictionary_encode(null_encoding="encode")
    words, word = tokens.dictionary, tokens.indices.to_numpy().astype(np.int64)
    gram, strings, found, base = np.zeros(len(word), np.int64), [], [], 0
    for n in range(1, n_max + 1):  # an n-gram is the one before it and one more token of the same row
        m = max(len(word) - n + 1, 0)
        key, at, gram_of = np.unique(gram[:m] * len(words) + word[n - 1:], return_index=True, return_inverse=True)
        gram = gram_of
        if n < n_min:
            continue
        whole = np.flatnonzero(row[:m] == row[n - 1:])
        parts = [words.take(pa.array(word[at + k])) for k in range(n)]
        joined = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if n > 1 else parts[0]
        if n > 1 and joined.null_count:  # null tokens are left out of a longer n-gram
            some = [" ".join(t for t in gram if t is not None) for gram in zip(*(p.filter(joined.is_null()).to_pylist() for p in parts), strict=True)]
            joined = pc.replace_with_mask(joined, joined.is_null(), pa.array(some, pa.large_string()))
        strings.append(joined)
        found.append((row[whole], gram[whole] + base))
        base += len(key)
    doc, of = ids.indices.to_numpy()[np.concatenate([f[0] for f in found])].astype(np.int64), np.concatenate([f[1] for f in found])
    of, pos = np.unique(of, return_inverse=True)  # those that do not go over the end of a row
    named = pa.chunked_array(strings, pa.large_string()).combine_chunks().take(pa.array(of)).dictionary_encode()  # a null token is no term
    terms, code = named.dictionary, named.indices.fill_null(-1).to_numpy()[pos].astype(np.int64)
    doc, code = doc[code >= 0], code[code >= 0]
    bucket = (pd.util.hash_array(terms.to_numpy(zero_copy_only=False)) % np.uint64(buckets)).astype(np.int64) if len(terms) else np.zeros(0, np.int64)
    order = pc.sort_indices(terms).to_numpy().astype(np.int64)
    order = order[np.argsort(bucket[order], kind="stable")]
    place = np.empty(len(terms), np.int64)
    place[order] = np.arange(len(terms))
    pair, n = np.unique(doc * max(len(terms), 1) + place[code], return_counts=True)
    return ids.dictionary, terms.take(pa.array(order)), bucket[order], pair // max(len(terms), 1), pair % max(len(terms), 1), n


def _counted(docs: DataFrame, id_col: str, tokens_col: str, n_min: int, n_max: int, min_df: int, max_df: float,
             block_tokens: int, listed, schema: str) -> tuple[DataFrame, int]:
    """``doc`` and what ``listed`` makes of each block's counts, and the number of rows of ``docs``; see :func:`term_lists`."""
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.greatest(F.size(tokens_col), F.lit(0))), F.lit(0)).alias("tokens")).first()
    n_docs, blocks = size["n"], max(1, -(-size["tokens"] // block_tokens))
    hi = max_df * n_docs if isinstance(max_df, float) else max_df
    dealt = _dealt(docs, id_col, tokens_col, blocks)
    kind = dealt.schema["doc"].dataType.simpleString()

    def ask(table):
        import pyarrow as pa
        block = table["block"][0].as_py()
        _, terms, bucket, _, term, _ = _block_counts(table, n_min, n_max, blocks)
        held = np.bincount(term, minlength=len(terms))
        data, at = _buffers(terms)
        cut = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket)).tolist()
        out = [(block, int(bucket[lo]), bytes(data[at[lo]:at[hi]]), np.diff(at[lo:hi + 1]).astype(np.int32).tobytes(), held[lo:hi].astype(np.int32).tobytes())
               for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                        names=["block", "bucket", "data", "sizes", "held"])

    def answer(table):
        import pyarrow as pa
        sizes = [np.frombuffer(x.as_py(), np.int32) for x in table["sizes"]]
        at = np.append(0, np.cumsum(np.concatenate(sizes), dtype=np.int64))
        terms = _string_array(pa.py_buffer(b"".join(x.as_py() for x in table["data"])), at)
        held = np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in table["held"]])
        code = terms.dictionary_encode().indices.to_numpy()
        df = np.bincount(code, held).astype(np.int64)
        df = np.where((df >= min_df) & (df <= hi), df, 0)[code]
        cut = np.append(0, np.cumsum([len(x) for x in sizes])).tolist()
        df = [df[lo:hi].tobytes() for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
        return pa.table([table["block"], table["bucket"], pa.array(df, pa.binary())], names=["block", "bucket", "df"])

    def count(table, answers):
        import pyarrow as pa
        ids, terms, _, doc, term, n = _block_counts(table, n_min, n_max, blocks)
        answers = sorted(zip(answers["bucket"].to_pylist(), answers["df"].to_pylist(), strict=True))
        df = np.frombuffer(b"".join(d for _, d in answers), np.int64)
        kept = df[term] > 0
        doc, term, n = doc[kept], term[kept], n[kept]
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        lists = listed(terms, np.append(first, len(doc)), doc, term, n, df)
        return pa.table([ids.take(pa.array(doc[first])), *lists.values()], names=["doc", *lists])

    answers = dealt.groupBy("block").applyInArrow(ask, "block int, bucket int, data binary, sizes binary, held binary").groupBy(
        "bucket").applyInArrow(answer, "block int, bucket int, df binary")
    lists = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        count, f"doc {kind}, {schema}")
    return lists, n_docs


def term_lists(docs: DataFrame, id_col: str, tokens_col: str, n_min: int = 1, n_max: int = 2, min_df: int = 2,
               max_df: float = 0.9, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, int]:
    """``(doc, terms)``, one row for each document with a term of the vocabulary, and the number of rows of ``docs``.  ``terms`` are
    structs ``(term, n, df)``: the n-grams within the document-frequency limits, their counts and frequencies.

    Documents are dealt once, into blocks of about ``block_tokens`` tokens; rows of one id (or of none) are one document.  A
    block sends each of its distinct n-grams once, with the number of its documents that hold it, to the n-gram's bucket, and
    gets the frequencies back in the same order.  So what is shuffled is every text once and every block's vocabulary, not a row for
    every document's every n-gram, and a document's counts stay in one place.
    """
    def listed(terms, first, doc, term, n, df):
        import pyarrow as pa
        rows = pa.StructArray.from_arrays([terms.take(pa.array(term)).cast(pa.string()), pa.array(n, pa.int64()), pa.array(df[term])], ["term", "n", "df"])
        return {"terms": pa.ListArray.from_arrays(pa.array(first, pa.int32()), rows)}

    return _counted(docs, id_col, tokens_col, n_min, n_max, min_df, max_df, block_tokens, listed,
                    "terms array<struct<term:string,n:bigint,df:bigint>>")


def packed_column(values: np.ndarray, first: np.ndarray):
    """An Arrow binary array: the bytes of ``values`` from each of ``first`` to the next."""
    import pyarrow as pa
    values = np.ascontiguousarray(values)
    at = pa.py_buffer((first * values.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, at, pa.py_buffer(values)])


def unpacked_column(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """The values of an Arrow binary array, one row's after another's, and where each row's begin (and the last one's end)."""
    import pyarrow as pa
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.dtype(kind).itemsize
    if not len(column):
        return np.zeros(0, kind), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int32 if column.type == pa.binary() else np.int64)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if at[-1] == at[0]:
        return np.zeros(0, kind), (at - at[0]) // size
    return np.frombuffer(data[int(at[0]):int(at[-1])], kind), (at - at[0]) // size


def packed_counts(docs: DataFrame, id_col: str, tokens_col: str, n_min: int = 1, n_max: int = 2, min_df: int = 2,
                  max_df: float = 0.9, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, int]:
    """:func:`term_lists` with every document's terms in three binaries, ``(doc, keys, n, df)``: the terms' hashes of 64 bits in
    ascending order, their counts and frequencies (32 bits each).  A term takes about 10 bytes on disk."""
    def listed(terms, first, doc, term, n, df):
        import pandas as pd
        keys = pd.util.hash_array(terms.to_numpy(zero_copy_only=False)).view(np.int64) if len(terms) else np.zeros(0, np.int64)
        keys = keys[term]
        order = np.lexsort((keys, doc))
        return {"keys": packed_column(keys[order], first), "n": packed_column(n[order].astype(np.int32), first),
                "df": packed_column(df[term][order].astype(np.int32), first)}

    return _counted(docs, id_col, tokens_col, n_min, n_max, min_df, max_df, block_tokens, listed, "keys binary, n binary, df binary")


def term_counts(docs: DataFrame, id_col: str, tokens_col: str, n_min: int = 1, n_max: int = 2,
                min_df: int = 2, max_df: float = 0.9) -> tuple[DataFrame, DataFrame, int]:
    """Vocabulary with document-frequency limits and counts per document.

    Returns ``(counts(doc, term, n, df), vocab(term, df), n_docs)``.  ``max_df`` is a share of
    documents (float) or an absolute count (int), as in a count vectorizer.
    """
    lists, n_docs = term_lists(docs, id_col, tokens_col, n_min, n_max, min_df, max_df)
    counts = lists.select("doc", F.inline_outer("terms"))  # outer: no list is empty
    return counts, counts.select("term", "df").distinct(), n_docs


def collapse_counts(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``counts(doc, term, n, df)`` of one document for every distinct set of counts, the one of the least id, and
    ``members(doc, node)``: of all documents the one that stands for them.  Documents agree if two 64-bit hashes of their
    counts do, and the number of their terms.  ``counts`` may be :func:`packed_counts`, of which nothing but the copies is
    shuffled then."""
    if "keys" in counts.columns:
        key = [F.xxhash64(F.lit(i), "keys", "n").alias(f"h{i}") for i in (1, 2)]
        of = cut_lineage(counts.select("doc", *key, F.octet_length("keys").alias("h3")))
        least = of.groupBy("h1", "h2", "h3").agg(F.min("doc").alias("node"))
        members = cut_lineage(of.join(least, ["h1", "h2", "h3"]).select("doc", "node"))
        return _without(counts.where("doc is not null"), members.where("doc <> node").select("doc"), "doc"), members
    key = [F.bit_xor(F.xxhash64(F.lit(i), "term", "n")).alias(f"h{i}") for i in (1, 2)]
    of = counts.groupBy("doc").agg(*key, F.count(F.lit(1)).alias("h3"))
    least = of.groupBy("h1", "h2", "h3").agg(F.min("doc").alias("node"))
    members = of.join(least, ["h1", "h2", "h3"]).select("doc", "node")
    return counts.join(members.where("doc = node").select("doc"), "doc", "left_semi"), members


def _without(rows: DataFrame, gone: DataFrame, by: str) -> DataFrame:
    """``rows`` whose ``by`` (not null) is not in ``gone``.  A map of bounded size is broadcast, a bit for each hash of those gone;
    only rows whose bit is set are shuffled to be joined."""
    at = F.pmod(F.xxhash64(by), F.lit(MAP_BITS))
    row, bit = F.shiftright("__at", 6).alias("__row"), F.col("__at").bitwiseAND(F.lit(63)).cast("int")
    maps = gone.select(at.alias("__at")).select(row, F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("__map")).groupBy(
        "__row").agg(F.bit_or("__map").alias("__map"))
    is_set = F.coalesce(F.call_function("shiftright", F.col("__map"), bit).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    looked_up = rows.withColumn("__at", at).withColumn("__row", row).join(F.broadcast(maps), "__row", "left")
    names = [F.col(f"`{c}`") for c in rows.columns]
    return looked_up.where(~is_set).select(*names).unionByName(looked_up.where(is_set).select(*names).join(gone, by, "left_anti"))


def tfidf(counts: DataFrame, n_docs: int) -> DataFrame:
    """``n * (ln((1+N)/(1+df)) + 1)``, L2-normalised per document: ``(doc, term, df, w)``.  ``counts`` are rows
    ``(doc, term, n, df)``, or :func:`term_lists`, whose documents need no shuffle, or :func:`packed_counts`, which give
    ``(doc, keys, ws)``."""
    if "keys" in counts.columns:
        def run(batches):
            import pyarrow as pa
            for batch in batches:
                n, first = unpacked_column(batch.column(2), np.int32)
                df = unpacked_column(batch.column(3), np.int32)[0]
                w = n * (np.log((1.0 + n_docs) / (1.0 + df)) + 1.0)
                norm = np.sqrt(np.add.reduceat(w * w, first[:-1])) if len(w) else np.zeros(0)  # no list is empty
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed_column(w / np.repeat(norm, np.diff(first)), first)],
                                                 names=["doc", "keys", "ws"])

        doc = counts.schema["doc"].dataType.simpleString()
        return counts.select("doc", "keys", "n", "df").mapInArrow(run, f"doc {doc}, keys binary, ws binary")
    of = lambda n, df: n * (F.log((1.0 + n_docs) / (1.0 + df)) + 1.0)
    if "terms" in counts.columns:
        w = l2_normalize(F.transform("terms", lambda t: of(t["n"], t["df"])))
        rows = F.arrays_zip(F.col("terms.term").alias("term"), F.col("terms.df").alias("df"), w.alias("w"))
        return counts.select("doc", F.inline_outer(rows))  # outer: no list is empty, and a filter on it would evaluate it again
    raw = counts.withColumn("w", of(F.col("n"), F.col("df")))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))
    return raw.select("doc", "term", "df", (F.col("w") / norm).alias("w"))


def _carry(tokens: list, more: list, most: int) -> list:
    return (tokens + more)[-most:] if most else []


def _tail_of_part(most: int):
    """Of a task's rows (part, cluster, last) the last cluster's last ``most`` tokens, and whether the task has no other."""
    def run(batches):
        import pyarrow as pa
        tail, part, cluster, alone = [], None, None, True
        for batch in batches:
            for p, c, last in zip(*(batch.column(k).to_pylist() for k in ("part", "cluster", "last")), strict=True):
                if part is not None and c != cluster:
                    tail, alone = [], False
                part, cluster, tail = p, c, _carry(tail, last, most)
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([cluster], batch.schema.field("cluster").type),
                                              pa.array([tail], pa.list_(pa.string())), pa.array([alone])],
                                             names=["part", "cluster", "tail", "alone"])
    return run


def _with_before(most: int, held):
    """A task's rows with ``before``: up to ``most`` tokens of the cluster that come before the row's own."""
    def run(batches):
        import pyarrow as pa
        first, cluster, tail = True, None, []
        for batch in batches:
            before = []
            for p, c, last in zip(*(batch.column(k).to_pylist() for k in ("part", "cluster", "last")), strict=True):
                if first:
                    cluster, tail = held.value.get(p, (c, []))
                    first = False
                if c != cluster:
                    cluster, tail = c, []
                before.append(tail)
                tail = _carry(tail, last, most)
            yield pa.RecordBatch.from_arrays([batch.column("cluster"), batch.column("tok"), pa.array(before, pa.list_(pa.string()))],
                                             names=["cluster", "tok", "before"])
    return run


def _with_carry(docs: DataFrame, cluster_col: str, order_col: str, tokens_col: str, n_max: int) -> DataFrame:
    """``(cluster, tok, before)``: every message's tokens and those of its cluster, ``n_max - 1`` at the most, that come before.

    Rows are dealt by ranges of (cluster, order), so a cluster with most rows is many tasks, and each row gets the ``n_max - 1``
    tokens that come before it: those within a task by a carry, those over a border from the tasks' tails (a few tokens
    a task, the only rows that the driver sees).  Messages that tie come in the order of their tokens; a null cluster is one
    too; messages without tokens join their neighbours; an empty table has no n-gram.
    """
    most = n_max - 1
    rows = docs.select(F.col(cluster_col).alias("cluster"), F.col(order_col).alias("ord"), F.col(tokens_col).alias("tok")).where(F.size("tok") > 0)
    # rows that agree in all three follow one another in any case, and which comes first does not matter
    dealt = rows.repartitionByRange("cluster", "ord", "tok").sortWithinPartitions("cluster", "ord", "tok")
    last = F.slice("tok", F.greatest(F.size("tok") - most + 1, F.lit(1)), most) if most else F.array().cast("array<string>")
    dealt = cut_lineage(dealt.select(F.spark_partition_id().alias("part"), "cluster", "tok", last.alias("last")))
    kind = dealt.schema["cluster"].dataType.simpleString()
    ends = dealt.select("part", "cluster", "last").mapInArrow(
        _tail_of_part(most), f"part int, cluster {kind}, tail array<string>, alone boolean")
    held, cluster, tail, before = {}, None, [], None
    for r in sorted(ends.collect(), key=lambda r: r["part"]):  # one row a task
        if before is not None:
            held[r["part"]] = (cluster, tail)
        tail = _carry(tail, r["tail"], most) if before is not None and r["alone"] and r["cluster"] == cluster else list(r["tail"])
        cluster, before = r["cluster"], r["part"]
    held = docs.sparkSession.sparkContext.broadcast(held)
    return dealt.mapInArrow(_with_before(most, held), f"cluster {kind}, tok array<string>, before array<string>")


def _carried_grams(joined: DataFrame, n_min: int, n_max: int) -> DataFrame:
    def of(n: int) -> Column:
        some = F.slice("before", F.greatest(F.size("before") - (n - 1) + 1, F.lit(1)), n - 1)
        return gram_strings(F.concat(some, "tok") if n > 1 else F.col("tok"), n, n)

    return joined.select("cluster", F.explode(F.concat(*[of(n) for n in range(n_min, n_max + 1)])).alias("term"))


def spanning_grams(docs: DataFrame, cluster_col: str, order_col: str, tokens_col: str, n_min: int = 1, n_max: int = 3) -> DataFrame:
    """``(cluster, term)``: the n-grams of every cluster's messages joined to one text in the order of ``order_col``, one
    row for each occurrence; see :func:`_with_carry`."""
    return _carried_grams(_with_carry(docs, cluster_col, order_col, tokens_col, n_max), n_min, n_max)


def class_tfidf(docs: DataFrame, cluster_col: str, tokens_col: str, n_min: int = 1, n_max: int = 3,
                min_df: int = 1, span_messages: bool = False, order_col: str | None = None) -> DataFrame:
    """Class-based TF-IDF: every cluster is one document.

    ``score = count(cluster, t) / kept terms in cluster * (ln((C + 1) / (df(t) + 1)) + 1)``
    with ``C`` clusters (noise included) and ``df`` = clusters holding ``t``.  N-grams are
    built within each message, or with ``span_messages`` over all messages of a cluster joined in
    the order of ``order_col``.  ``(cluster, term, n, score)``.
    """
    if span_messages:
        if order_col is None:
            raise ValueError("span_messages needs order_col, the order of the messages")
        texts = _with_carry(docs, cluster_col, order_col, tokens_col, n_max)
        g = _carried_grams(texts, n_min, n_max)
    else:
        texts = docs.select(F.col(cluster_col).alias("cluster"), F.col(tokens_col).alias("tok"), F.array().cast("array<string>").alias("before"))
        g = texts.select("cluster", F.explode(gram_strings(F.col("tok"), n_min, n_max)).alias("term"))
    c = g.groupBy("cluster", "term").agg(F.count(F.lit(1)).alias("n"))
    n_clusters = docs.select(cluster_col).distinct().count()
    # cluster frequency per term as a window over (cluster, term) rows: one shuffle, and a
    # term's group holds at most one row per cluster (bounded by the number of clusters)
    kept = c.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("term"))).filter(F.col("df") >= min_df)
    # per-cluster totals as an aggregate joined back (one row per cluster), not a window: a
    # window partitioned by cluster would sort a whole cluster's vocabulary in one task.  Broadcast: a join by
    # cluster would deal all rows over as many tasks as there are clusters, and a top-k after it sort them there
    if min_df > 1:
        tot = kept.groupBy("cluster").agg(F.sum("n").alias("_tot"))
    else:  # all n-grams, by the lengths of the texts: none is made for it
        made = lambda n: F.greatest(F.least(F.size("before"), F.lit(n - 1)) + F.size("tok") - (n - 1), F.lit(0))
        tot = texts.groupBy("cluster").agg(F.sum(sum((made(n) for n in range(n_min, n_max + 1)), F.lit(0)).cast("long")).alias("_tot"))
    idf = F.log((n_clusters + 1.0) / (F.col("df") + 1.0)) + 1.0
    return kept.join(F.broadcast(tot), "cluster").select("cluster", "term", "n", ((F.col("n") / F.col("_tot")) * idf).alias("score"))


def reduce_dims(df: DataFrame, vec_col: str, k: int) -> DataFrame:
    """Truncated SVD (no centring) to ``k = max(1, min(k, dims - 1))`` components, rows
    projected on the right singular vectors and L2-normalised.

    The Gram matrix is summed task by task and added up by Spark; only its ``dims x dims``
    numbers reach the driver, whose eigenvectors are applied in Arrow batches.  An empty table
    gives an empty result.  Term rows have :func:`consensa.operators.svd.reduce_term_dims`.
    """
    from consensa.operators.svd import _gram
    gram = _gram(df, vec_col)
    dims = len(gram) if df.limit(1).count() else 0
    if not dims:
        return df.withColumn("reduced", F.array().cast("array<double>"))
    basis = np.linalg.eigh(gram)[1][:, ::-1][:, :max(1, min(k, dims - 1))]
    cols = [F.aggregate(F.zip_with(F.col(vec_col), F.array(*[F.lit(float(x)) for x in basis[:, j]]), lambda a, b: a * b), F.lit(0.0),
                        lambda acc, x: acc + x) for j in range(basis.shape[1])]
    return df.withColumn("reduced", l2_normalize(F.array(*cols)))
