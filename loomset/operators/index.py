"""A search index: chunks of all distinct texts, their term weights, and vectors of fewer dimensions.

Vocabulary and directions are fitted on a sample that is bounded by design (MAX_DOCUMENTS, the same ones each time). Chunks, term weights and
vectors are then made of every distinct text with what was fitted, so that search can return any of them. Directions are found by subspace iteration: each round, every task multiplies its rows with
the directions so far and back, and blocks of the products are summed where the blocks meet; only the small basis visits the driver.
"""

from __future__ import annotations

import gc
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomset.operators import clean, counting, postings, retrieval, sampling, text, topics
from loomset.session import kept
from loomset.sources import files

MAX_DOCUMENTS, DIMENSIONS, ROUNDS = 20_000, 128, 7
BLOCK = 8_192
#: Tasks of a round at most: each gives an array of terms x dimensions.
TASKS = 4
#: Questions that are answered in one pass over the index.
QUESTIONS = 512


@dataclass
class Index:
    """chunks: all columns with chunk_id; postings: chunk_id, term, weight; vectors: chunk_id, vector (of length one).

    rows: where chunk_ids are there once, all of that and the chunks' other columns (without the text) as one row a chunk with places and values.
    """

    chunks: DataFrame
    vocabulary: DataFrame
    terms: DataFrame
    postings: DataFrame
    vectors: DataFrame
    directions: np.ndarray
    explained: float
    rows: DataFrame | None = None


def _summed(parts: DataFrame) -> np.ndarray:
    """The sum of flat arrays that came as (block, values)."""

    def add(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.column("values").combine_chunks()
        total = rows.flatten().to_numpy().reshape(len(rows), -1).sum(0, dtype=np.float64)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "values": _listed(total)})

    found = parts.groupBy("block").applyInArrow(add, "block int, values array<double>").toArrow().sort_by("block")
    return found.column("values").combine_chunks().flatten().to_numpy() if found.num_rows else np.zeros(0)


def _listed(flat: np.ndarray) -> pa.Array:
    """One list of all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat))


def _emit(flat: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k, at in enumerate(range(0, len(flat), BLOCK)):
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), _listed(flat[at : at + BLOCK])], ["block", "values"])


def directions(rows: DataFrame, width: int, dimensions: int, rounds: int = ROUNDS, seed: int = 42) -> tuple[np.ndarray, float]:
    """(width x dimensions orthonormal columns, share of the variance that they explain). rows: places and values."""
    dimensions = min(dimensions, width - 1)
    if dimensions < 2:
        raise ValueError("too few terms for an index")
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, dimensions)))[0]
    context = rows.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast(basis)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros((width, dimensions))
            for batch in batches:
                for part in topics.sparse(batch):
                    _back(*part, topics.times(*part, shared.value), total)
            yield from _emit(total.ravel().astype(np.float32))  # a task's part; the parts are added in double precision

        product = _summed(rows.select("places", "values").mapInArrow(run, "block int, values array<float>"))
        shared.destroy()
        # else the parts of all rounds stay on disk until the driver happens to collect its garbage
        gc.collect()
        context._jvm.System.gc()
        if not len(product):
            return basis, 0.0
        basis = np.linalg.qr(product.reshape(width, dimensions))[0]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, width)), np.zeros((2, dimensions)), 0
        full, small, n = sums
        for batch in batches:
            for part in topics.sparse(batch):
                _, place, value, many = part
                y = topics.times(*part, basis)
                full += [np.bincount(place, value, width), np.bincount(place, value**2, width)]
                small += [y.sum(0), (y**2).sum(0)]
                n += many
        yield from _emit(np.concatenate([full.ravel(), small.ravel(), [n]]))

    flat = _summed(rows.select("places", "values").mapInArrow(spread, "block int, values array<double>"))
    n = flat[-1]
    full, small = flat[: 2 * width].reshape(2, width), flat[2 * width : -1].reshape(2, dimensions)
    variance = lambda s: float((s[1] / n - (s[0] / n) ** 2).sum())
    return basis, variance(small) / max(variance(full), 1e-12)


def _back(row: np.ndarray, place: np.ndarray, value: np.ndarray, n: int, y: np.ndarray, total: np.ndarray) -> None:
    """Adds the transposed sparse rows times y."""
    if len(row):
        order = np.argsort(place, kind="stable")
        at = place[order]
        start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        total[at[start]] += np.add.reduceat(y[row[order]] * value[order][:, None], start)


def project(rows: DataFrame, key: str, basis: np.ndarray) -> DataFrame:
    """key and vector (of length one; all zeros if nothing of the row is in the directions)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = np.concatenate([topics.times(*part, basis) for part in topics.sparse(batch)])
                y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
                offsets = pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(offsets, pa.array(y.astype(np.float32).ravel()))], [key, "vector"])

    return rows.select(key, "places", "values").mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, vector array<float>")


def counts_of(texts: DataFrame, key: str, body: str, among: DataFrame | None = None) -> DataFrame:
    """key, term and tf as the index counts them, of texts and of questions."""
    return text.term_counts(texts, key, body, bigrams=True, among=among)


def build(texts: DataFrame, key: str, body: str, group: str, most: int = MAX_DOCUMENTS, dimensions: int = DIMENSIONS, features: int = 30_000, rounds: int = ROUNDS) -> Index:
    """Indexes all distinct texts by what a balanced sample of `most` of them teaches. What is read more than once is a table under spark.checkpoint.dir."""
    distinct = clean.keep_first(texts.filter(F.col(body).isNotNull()).withColumn("_sha", F.sha2(F.col(body).cast("string"), 256)), "_sha", key).drop("_sha")
    chunks = kept(text.chunks(distinct, key, body), "chunks")
    taught = sampling.balanced(chunks.filter("chunk_index = 0").select(key, group), key, group, most)
    sample = kept(chunks.join(taught.select(key), key, "left_semi").select("chunk_id", "chunk_text"), "sample")  # all chunks of `most` documents
    counts = kept(counts_of(sample, "chunk_id", "chunk_text"), "counts")
    vocabulary = kept(text.vocabulary(counts, sample.count(), max_features=features), "vocabulary")
    terms = kept(topics.numbered(vocabulary.select("term")), "terms")
    rows = kept(topics.rows_of(text.weights(counts, F.broadcast(vocabulary), "chunk_id"), terms, "chunk_id"), "rows").coalesce(TASKS)
    basis, explained = directions(rows, terms.count(), dimensions, rounds)
    return assemble(chunks, vocabulary, terms, basis, explained)


def _others(chunks: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in chunks.columns if c not in ("chunk_id", "chunk_text"))


def taught(chunks: DataFrame, features: int = 30_000) -> tuple[DataFrame, DataFrame | None]:
    """(vocabulary of all chunks, their words for assemble(); none if chunk_ids repeat, whose chunks are counted together)."""
    if counting.unique(chunks, "chunk_id"):
        held = kept(counting.words(chunks, "chunk_id", "chunk_text", *_others(chunks)), "words")
        found = counting.vocabulary(held, chunks.count(), bigrams=True, max_features=features)
        if found is not None:
            return kept(found, "vocabulary"), held
    counts = kept(counts_of(chunks, "chunk_id", "chunk_text"), "counts")
    return kept(text.vocabulary(counts, chunks.count(), max_features=features), "vocabulary"), None


def assemble(chunks: DataFrame, vocabulary: DataFrame, terms: DataFrame, basis: np.ndarray, explained: float = 0.0, held: DataFrame | None = None) -> Index:
    """The index of chunks (with chunk_id and chunk_text) for a vocabulary and directions that are there already. held: the words of chunks whose ids are there once."""
    if held is None and counting.unique(chunks, "chunk_id"):
        held = counting.words(chunks, "chunk_id", "chunk_text", *_others(chunks))
    if held is None:
        weights = kept(text.weights(counts_of(chunks, "chunk_id", "chunk_text", vocabulary), F.broadcast(vocabulary), "chunk_id"), "postings")
        vectors = kept(project(topics.rows_of(weights, terms, "chunk_id"), "chunk_id", basis), "vectors")
        return Index(chunks, vocabulary, terms, weights, vectors, basis, explained)
    rows = kept(counting.rows(held, "chunk_id", vocabulary.join(terms, "term"), basis, _others(chunks)), "rows")
    return Index(chunks, vocabulary, terms, _placed(rows).join(F.broadcast(terms), "place").select("chunk_id", "term", "weight"), rows.select("chunk_id", "vector"), basis, explained, rows)


def _placed(rows: DataFrame) -> DataFrame:
    """chunk_id, place and weight."""
    return rows.select("chunk_id", F.explode(F.arrays_zip("places", "values")).alias("x")).select("chunk_id", F.col("x.places").alias("place"), F.col("x.values").alias("weight"))


_FRAMES = ("chunks", "vocabulary", "terms", "postings", "vectors")


def save(index: Index, folder: str) -> dict:
    """Writes the index as Parquet tables and a manifest of one JSON line, and returns the manifest. The manifest is written last: without it there is no index."""
    spark = index.chunks.sparkSession
    for name in _FRAMES:
        frame = getattr(index, name)
        if name == "postings":  # a question reads the folders of its terms alone
            bucket = postings.bucket(F.col("term"), postings.BUCKETS).alias("bucket")
            dealt = F.pmod(F.xxhash64("chunk_id"), F.lit(postings.FILES))
            if index.rows is None:
                frame = frame.select("chunk_id", "term", "weight", bucket).repartition("bucket", dealt).sortWithinPartitions("bucket", "term")
            else:  # terms are numbered in their order, and numbers are smaller to deal out and sort
                frame = _placed(index.rows).join(F.broadcast(index.terms.select("place", bucket)), "place").repartition("bucket", dealt).sortWithinPartitions("bucket", "place")
                frame = frame.join(F.broadcast(index.terms), "place").select("chunk_id", "term", "weight", "bucket")
        writer = frame.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy("bucket") if name == "postings" else writer).parquet(f"{folder}/{name}")
    basis = pa.table({"place": pa.array(np.arange(len(index.directions)), pa.int32()), "direction": pa.array(index.directions.tolist(), pa.list_(pa.float64()))})
    spark.createDataFrame(basis).write.mode("overwrite").parquet(f"{folder}/directions")  # features x dimensions at most
    rows = {name: spark.read.parquet(f"{folder}/{name}").count() for name in _FRAMES}
    digests = {name: files.digest(spark, f"{folder}/{name}") for name in (*_FRAMES, "directions")}
    manifest = {"rows": rows, "digests": digests, "features": len(index.directions), "dimensions": int(index.directions.shape[1]), "explained_variance": index.explained}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest.json")
    return manifest


def load(spark: SparkSession, folder: str, verify: bool = False) -> Index:
    """A saved index. Missing parts, or tables whose rows differ from the manifest or from each other, are an error. verify: so are files whose digest differs."""
    try:
        manifest = json.loads(spark.read.text(f"{folder}/manifest.json").first()[0])
        frames = {name: spark.read.parquet(f"{folder}/{name}") for name in _FRAMES}
        basis = spark.read.parquet(f"{folder}/directions").orderBy("place").toArrow()
    except Exception as e:
        raise FileNotFoundError(f"no complete index in {folder}: {str(e).splitlines()[0]}") from None
    rows = {name: frame.count() for name, frame in frames.items()}
    if rows != manifest["rows"] or rows["vectors"] > rows["chunks"] or rows["terms"] != rows["vocabulary"] or basis.num_rows != manifest["features"]:
        raise ValueError(f"the tables of the index in {folder} do not reconcile: {rows}, manifest {manifest['rows']}")
    if verify and (changed := [name for name, held in manifest["digests"].items() if files.digest(spark, f"{folder}/{name}") != held]):
        raise ValueError(f"files of the index in {folder} have changed: {', '.join(changed)}")
    flat = basis.column("direction").combine_chunks().flatten().to_numpy()
    return Index(*(frames[name] for name in _FRAMES), flat.reshape(manifest["features"], manifest["dimensions"]), manifest["explained_variance"])


_opened: dict[tuple[str, str], Index] = {}


def opened(spark: SparkSession, folder: str) -> Index:
    """A saved index, loaded once for an application."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _opened:
        _opened[key] = load(spark, folder)
    return _opened[key]


def _buckets(spark: SparkSession, terms: list[str]) -> list[int]:
    rows = spark.createDataFrame([(t,) for t in terms], "term string").select(postings.bucket(F.col("term"), postings.BUCKETS).alias("b")).distinct()
    return [r["b"] for r in rows.collect()]


def search(index: Index, query: str, top_k: int = 8, filters: retrieval.Filters | None = None, dense_weight: float = 0.65, min_score: float = 0.05) -> DataFrame:
    """rank, chunk_id, lexical, dense, score and all columns of the best chunks; no rows if the filters leave none."""
    query = retrieval.check_request(query, top_k, dense_weight)
    spark = index.chunks.sparkSession
    counts = counts_of(spark.createDataFrame([(0, query)], "_q int, query string"), "_q", "query")
    weights = text.weights(counts, index.vocabulary, "_q")
    found = topics.rows_of(weights, index.terms, "_q").first()
    asked = [r["term"] for r in weights.select("term").collect()]  # one question's
    held = index.postings
    if "bucket" in held.columns:
        held = held.filter(F.col("bucket").isin(_buckets(spark, asked)))
    held = held.filter(F.col("term").isin(asked))
    vector = np.zeros(len(index.directions))
    if found:
        vector[found["places"]] = found["values"]
    filters = filters or retrieval.Filters()
    candidates = index.chunks.filter(filters.condition(index.chunks.columns)).select("chunk_id")
    lexical = retrieval.lexical_scores(held, weights.select("term", F.col("weight").alias("query_weight")), "chunk_id")
    dense = retrieval.dense_scores(index.vectors, "chunk_id", "vector", (vector @ index.directions).tolist())
    best = retrieval.top(retrieval.hybrid(candidates, lexical, dense, "chunk_id", dense_weight), "chunk_id", top_k, min_score)
    return index.chunks.join(F.broadcast(best), "chunk_id").orderBy("rank")  # top_k rows


def search_many(index: Index, questions: DataFrame, top_k: int = 8, match: tuple[str, ...] = (), dense_weight: float = 0.65, min_score: float = 0.05) -> DataFrame:
    """question, rank, chunk_id, lexical, dense and score: what search() gives for each of many questions (question, query).

    match: columns that chunks and questions have; a question finds chunks with its own value there (null: any), case left aside. Questions are taken
    in blocks of about QUESTIONS; a block is a small matrix for each value that they ask for, which each task multiplies with its rows of that value, holding the top_k best of each question. So a
    block is one pass over the index, and what is shuffled is top_k rows for each question and task. Questions without a known term find nothing.
    """
    retrieval.check_request("any", top_k, dense_weight)
    spark = index.chunks.sparkSession
    asked = questions.select("question", "query", *match)
    weights = text.weights(counts_of(asked, "question", "query", index.vocabulary), index.vocabulary, "question")
    asked = kept(topics.rows_of(weights, index.terms, "question").join(asked.select("question", *match), "question"), "questions")
    count = asked.count()
    blocks = max(1, -(-count // QUESTIONS))
    folded = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"match_{k}") for k, c in enumerate(match)]
    if index.rows is not None:
        rows = index.rows.select("chunk_id", "places", "values", "vector", *folded)
    else:
        rows = topics.rows_of(index.postings.select("chunk_id", "term", "weight"), index.terms, "chunk_id").join(index.vectors, "chunk_id")
        rows = kept(rows.join(index.chunks.select("chunk_id", *folded), "chunk_id") if match else rows, "search-rows")
    kind = asked.schema["question"].dataType.simpleString()
    out = None
    for k in range(blocks):
        some = asked.filter(F.pmod(F.xxhash64("question"), F.lit(blocks)) == k).toArrow()
        if not some.num_rows:
            continue
        wanted = list(zip(*([None if v is None else str(v).lower() for v in some.column(c).to_pylist()] for c in match), strict=True)) or [()] * some.num_rows
        same: dict[tuple, list[int]] = {}
        for j, values in enumerate(wanted):
            same.setdefault(tuple(v or None for v in values), []).append(j)
        groups = [(values, np.array(js), *_matrix(some.take(js), index.directions)) for values, js in same.items()]
        shared = spark.sparkContext.broadcast((some.column("question").combine_chunks(), groups))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, groups = shared.value
            best = postings.Best(len(names), top_k, min_score)
            for batch in batches:
                own = [np.array(batch.column(f"match_{c}").to_pylist(), object) for c in range(len(match))]
                at = 0
                for row, place, value, n in topics.sparse(batch):
                    keys, vectors = batch.column("chunk_id").slice(at, n), batch.column("vector").slice(at, n).flatten().to_numpy().reshape(n, -1).astype(np.float64)
                    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
                    for values, js, known, matrix, points in groups:
                        fits = np.ones(n, bool)
                        for c, v in enumerate(values):
                            if v:
                                fits &= own[c][at : at + n] == v
                        mine = np.flatnonzero(fits)
                        if not len(mine):
                            continue
                        local = known[place]
                        use = (local >= 0) & fits[row]
                        lexical = topics.product((np.cumsum(fits) - 1)[row[use]], local[use], value[use], len(mine), matrix)
                        dense = np.clip(vectors[mine] @ points.T, 0, 1)
                        best.offer(js, keys.take(pa.array(mine)), dense_weight * dense + (1 - dense_weight) * lexical, lexical, dense)
                    at += n
            which = [j for j, held in enumerate(best.rows) for _ in held]
            flat = [x for held in best.rows for x in held]
            columns = [names.take(pa.array(which, pa.int64())), pa.array([x[1] for x in flat], pa.string()), *(pa.array([x[c] for x in flat], pa.float64()) for c in (2, 3)), pa.array([-x[0] for x in flat], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["question", "chunk_id", "lexical", "dense", "score"])

        found = kept(rows.mapInArrow(run, f"question {kind}, chunk_id string, lexical double, dense double, score double"), "found")
        shared.destroy()
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], f"question {kind}, rank long, chunk_id string, lexical double, dense double, score double")
    order = Window.partitionBy("question").orderBy(F.desc("score"), "chunk_id")
    ranked = out.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top_k)
    return ranked.select("question", "rank", "chunk_id", "lexical", "dense", "score")


def _matrix(some: pa.Table, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each place is in the matrix, or -1; known places x questions; questions x dimensions, of length one) of some questions."""
    places = [np.asarray(x, np.int64) for x in some.column("places").to_pylist()]
    known = np.unique(np.concatenate(places))
    matrix = np.zeros((len(known), some.num_rows))
    for j, (at, values) in enumerate(zip(places, some.column("values").to_pylist(), strict=True)):
        matrix[np.searchsorted(known, at), j] = values
    points = matrix.T @ directions[known]
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
    where = np.full(len(directions), -1, np.int64)
    where[known] = np.arange(len(known))
    return where, matrix, points
