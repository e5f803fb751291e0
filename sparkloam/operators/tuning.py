"""Labelled text lines, folds, parameter grids and cross-validated search."""

from __future__ import annotations

import hashlib
import os
import pkgutil
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from .sorting import ranked, running_sum

#: Fixed values of the searched grid.
GRID = {"norm": ["l1", "l2"], "ngram": [1, 2], "alpha": [1e-2, 1e-3, 1e-4, 1e-5], "max_iter": [10, 30, 50, 80], "penalty": ["l2", "l1", "elasticnet"]}


def parse_lines(lines: DataFrame) -> DataFrame:
    """`__label__N text` in column value to y (from 0) and x."""
    return lines.withColumn("y", F.substring("value", 10, 1).cast("int") - 1).withColumn("x", F.expr("substring(value, 12)"))


def cap(rows: DataFrame, order: list[str], chars: int) -> DataFrame:
    """Rows up to and with the one whose length takes the running total over the cap."""
    return running_sum(rows, order, F.length("x").cast("long"), "before").where(F.col("before") <= chars)


def first_lines(rows: DataFrame, order: list[str], lines: int) -> DataFrame:
    """At most so many rows, the first in order; the limit is the feature."""
    return ranked(rows, order, "_place").where(F.col("_place") < lines).drop("_place")


def folds(rows: DataFrame, order: str, k: int = 5) -> DataFrame:
    """Unshuffled stratified folds: each label's rows in order, in k near-equal runs."""
    placed = ranked(rows, ["y", order])
    sizes = placed.groupBy("y").agg(F.min("rank").alias("first"), F.count("*").alias("n"))
    placed = placed.join(F.broadcast(sizes), "y")  # a row a label
    r, n = F.col("rank") - F.col("first"), F.col("n")
    each, more = F.floor(n / k), n % k
    in_long = F.floor(r / (each + 1))
    rest = more + F.floor((r - more * (each + 1)) / F.greatest(each, F.lit(1)))
    return placed.withColumn("fold", F.when(r < more * (each + 1), in_long).otherwise(rest).cast("int")).drop("rank", "first", "n")


def grid(spark, values: dict[str, list] = GRID) -> DataFrame:
    out = spark.range(1).drop("id")
    for name, own in values.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, own))))
    return out


#: Share of the absolute penalty.
NETS = {"l2": 0.0, "l1": 1.0, "elasticnet": 0.15}
#: Labelled rows of a block, on average.
SHARD = 512
#: Words of a lower-cased text: two or more letters, digits or underscores.
WORD = "[a-z0-9_][a-z0-9_]+"


def hashed_terms(rows: DataFrame, id_column: str, text_column: str, *, features: int = 1 << 18, ngram: int = 1, norm: str | None = "l2") -> DataFrame:
    """(id, bucket, value): words of two or more letters, digits or underscores of the
    lower-cased text and, up to ngram, runs of them, counted by the bucket that md5 puts them
    in. Values have length 1 by the norm; without one they are counts."""
    if not 1 <= ngram <= 2 or features > 1 << 20:
        raise ValueError("ngram is 1 or 2, features are at most 2**20")
    words = F.expr(f"regexp_extract_all(lower(`{text_column}`), '{WORD}', 0)")
    pairs = F.expr("transform(sequence(1, size(w) - 1), i -> concat(w[i - 1], ' ', w[i]))")
    terms = F.col("w") if ngram == 1 else F.concat("w", F.when(F.size("w") > 1, pairs).otherwise(F.array().cast("array<string>")))
    out = rows.select(F.col(id_column).alias("id"), words.alias("w")).select("id", F.explode(terms).alias("t"))
    bucket = F.conv(F.substring(F.md5(F.col("t").cast("binary")), 1, 5), 16, 10).cast("int") % features
    out = out.groupBy("id", bucket.alias("bucket")).agg(F.count("*").cast("double").alias("value"))
    if norm is None:
        return out
    size = out.groupBy("id").agg((F.sum("value") if norm == "l1" else F.sqrt(F.sum(F.col("value") ** 2))).alias("size"))
    return out.join(size, "id").select("id", "bucket", (F.col("value") / F.col("size")).alias("value"))


def hinge_path(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, features: int, alpha: float, net: float, stops: list[int], seed: int = 0, blocks: list[np.ndarray] | None = None) -> list[tuple[np.ndarray, float]]:
    """Weights and intercept of a linear classifier with hinge loss, by stochastic gradient
    descent, after each number of epochs in stops. x: indices and values; y: -1 or 1;
    blocks: the numbers of all rows, by block (all rows are one). An epoch meets every row:
    blocks in a new order, and in each its rows in a new order.

    The step falls as 1 / (alpha * t). The squared part of the penalty shrinks all weights
    by a common factor; the absolute part is added up and taken from a weight when its
    feature is met. Descent ends when the loss has not fallen for five epochs. Descent.java
    does the same; this is what it is held against."""
    v, scale, intercept = np.zeros(features), 1.0, 0.0
    due, paid = 0.0, np.zeros(features)
    t, r = alpha**-0.75, np.random.default_rng(seed)  # the first step is alpha ** -0.25
    order = [np.array(b) for b in blocks] if blocks else [np.arange(len(y))]
    turn = np.arange(len(order))
    out, best, stale = [], np.inf, 0
    for epoch in range(1, max(stops) + 1):
        if stale < 5:
            loss = 0.0
            r.shuffle(turn)
            for block in turn:
                r.shuffle(order[block])
                for i in order[block]:
                    at, val = x[i]
                    step = 1 / (alpha * t)
                    margin = y[i] * (scale * (v[at] @ val) + intercept)
                    loss += max(0.0, 1 - margin)
                    scale *= max(1e-9, 1 - (1 - net) * step * alpha)
                    if margin < 1:
                        v[at] += step * y[i] / scale * val
                        intercept += 0.01 * step * y[i]
                    if net:
                        due += net * step * alpha
                        w = scale * v[at]
                        new = np.where(w > 0, np.maximum(0, w - (due + paid[at])), np.minimum(0, w + (due - paid[at])))
                        paid[at] += new - w
                        v[at] = new / scale
                    if scale < 1e-6:
                        v, scale = v * scale, 1.0
                    t += 1
            stale = stale + 1 if loss > best - 1e-3 * len(y) else 0
            best = min(best, loss)
        if epoch in stops:
            out.append((scale * v, intercept))
    return out


def hashed_rows(words: pa.Array, features: int, ngrams: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each ngram (row, bucket, value) of hashed_terms() without a norm, from the words of
    each row."""
    ends = np.concatenate([[0], np.cumsum(words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    code, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), [t.encode() for t in coded.dictionary.to_pylist()]
    row = np.repeat(np.arange(len(words)), np.diff(ends))
    md5 = hashlib.md5
    place = lambda terms: (np.frombuffer(b"".join([md5(t).digest()[:4] for t in terms]), ">u4").astype(np.int64) >> 12) % features
    buckets = place(names)[code]
    for ngram in ngrams:
        key = row * features + buckets
        if ngram == 2 and len(code):
            two = np.flatnonzero(row[1:] == row[:-1])
            pairs, which = np.unique(code[two] * len(names) + code[two + 1], return_inverse=True)
            first, second = np.divmod(pairs, len(names))
            pairs = place([names[i] + b" " + names[j] for i, j in zip(first.tolist(), second.tolist())])
            key = np.concatenate([key, row[two] * features + pairs[which]])
        key, n = np.unique(key, return_counts=True)
        yield ngram, key // features, key % features, n


def merged(row: np.ndarray, bucket: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, index, n, copies): buckets that occur in the same rows as often get the same weights,
    whatever they are trained on, and so become one feature with its copies. Those of many
    rows come first, those of one row by row. For rows that are all at hand; search_grid() sees
    a block at a time and does without."""
    order = np.lexsort((row, bucket))
    row, bucket, n = row[order], bucket[order], n[order]
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    sizes = np.diff(np.append(starts, len(bucket)))
    group, known, wide = np.zeros(len(starts), dtype=np.int64), {}, sizes > 1
    held = np.stack([row, n], 1)
    for i, a, b in zip(np.flatnonzero(wide).tolist(), starts[wide].tolist(), (starts + sizes)[wide].tolist()):
        group[i] = known.setdefault(held[a:b].tobytes(), len(known))
    one = starts[~wide]
    group[~wide] = len(known) + np.unique(row[one] * (n.max(initial=0) + 1) + n[one], return_inverse=True)[1]
    _, lead, copies = np.unique(group, return_index=True, return_counts=True)
    by = np.lexsort((np.arange(len(lead)), -sizes[lead]))
    index = np.zeros(len(lead), dtype=np.int64)
    index[by] = np.arange(len(by))
    keep = np.zeros(len(starts), dtype=bool)
    keep[lead] = True
    taken = np.repeat(keep, sizes)
    return row[taken], np.repeat(index[group], sizes)[taken], n[taken], copies[by].astype(float)


#: The largest count of one entry of a block; larger ones take several.
MOST = (1 << 12) - 1


def packed(words: pa.Array, y: np.ndarray, fold: np.ndarray, values: dict[str, list], *, features: int) -> bytes:
    """A block of Descent.java: numbers of rows, ngrams, norms and entries; for each row and ngram
    where its entries end, folds and labels; entries, which hold bucket and count and are in order
    of rows, a row's words before its pairs; for each norm and ngram what a row's counts are to be
    multiplied by."""
    ngrams, n = sorted({*values["ngram"]}), len(y)
    rows, parts, sizes, before = np.arange(n), [], {}, None
    for place, (ngram, row, bucket, count) in enumerate(hashed_rows(words, features, ngrams)):
        sizes["l1", ngram], sizes["l2", ngram] = np.bincount(row, count, n), np.sqrt(np.bincount(row, count * count, n))
        key, own = row * features + bucket, count.copy()
        if before:  # what the shorter ones have is there already
            own[np.searchsorted(key, before[0])] -= before[1]
        before = key, count
        keep = own > 0
        times = -(-own[keep] // MOST)
        held = np.full(times.sum(), MOST)
        held[np.cumsum(times) - 1] = own[keep] - MOST * (times - 1)
        parts.append((np.repeat(row[keep] * len(ngrams) + place, times), np.repeat(bucket[keep], times) << 12 | held))
    key, entry = map(np.concatenate, zip(*parts))
    by = np.argsort(key, kind="stable")
    ends = np.searchsorted(key[by], np.arange(n * len(ngrams)), side="right")
    factors = [1 / np.where(sizes[norm, ngram] > 0, sizes[norm, ngram], 1)[rows] for norm in values["norm"] for ngram in ngrams]
    head = [np.asarray(a).astype("<i4").tobytes() for a in ([n, len(ngrams), len(values["norm"]), len(entry)], ends, fold, y)]
    return b"".join([*head, entry[by].astype("<u4").tobytes(), *(f.astype("<f8").tobytes() for f in factors)])


def descents(spark) -> tuple[str, str]:
    """Names of the functions of Descent.java in this session: one that stores a block and one
    that descends. Spark's own compiler makes their class, which executors get as a jar from the
    driver."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    names = "sparkloam_block", "sparkloam_descents"
    if spark.catalog.functionExists(names[1]):
        return names
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader())
    compiler.cook(pkgutil.get_data(__package__, "Descent.java").decode())
    code = compiler.getBytecodes()
    jar = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="sparkloam-")), f"descent-{uuid.uuid4().hex}.jar")
    with zipfile.ZipFile(jar, "w") as out:
        for made in code:
            out.writestr(made.replace(".", "/") + ".class", bytes(code[made]))
    spark.sparkContext._jsc.addJar(jar)
    urls = gateway.new_array(jvm.java.net.URL, 1)
    urls[0] = jvm.java.io.File(jar).toURI().toURL()
    loader = jvm.java.net.URLClassLoader(urls, jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader())
    for name, made, kind in zip(names, ("Block", "Descent"), ('"long"', '{"type":"array","elementType":"long","containsNull":false}')):
        spark._jsparkSession.udf().register(name, loader.loadClass(f"sparkloam.{made}").newInstance(), spark._jsparkSession.parseDataType(kind))
    return names


def search_grid(rows: DataFrame, values: dict[str, list] = GRID, *, id_column: str = "doc_id", features: int = 1 << 18, shard: int = SHARD, k: int = 5) -> DataFrame:
    """(norm, ngram, alpha, max_iter, penalty, accuracy): mean accuracy over the k folds for
    every combination of the values. rows: id, x, y (0 or 1), fold.

    Each model is trained on all rows outside its fold, and tried on all in it. Rows are hashed
    in blocks of some `shard` rows, which go to the shared folder until the search has ended. A
    task trains the models of one fold, norm, ngram and penalty, whose numbers of epochs share
    one descent; it reads one block after the other in every epoch. An executor keeps blocks in
    memory between epochs as far as they fit into a part of it."""
    if not {*values["ngram"]} <= {1, 2} or not {*values["norm"]} <= {"l1", "l2"} or features > 1 << 20:
        raise ValueError("ngram is 1 or 2, norm l1 or l2, features are at most 2**20")
    spark = rows.sparkSession
    shards = max(1, -(-rows.count() // shard))
    dealt = rows.select(F.col(id_column).alias("id"), F.pmod(F.xxhash64(id_column), F.lit(shards)).cast("int").alias("shard"), "y", "fold", F.lower("x").alias("x"))
    # Little data is much work here: partitions are not to be put together by their bytes.
    dealt = dealt.repartitionById(shards, "shard")
    store, descend = descents(spark)
    folder = f"{shared_dir(spark).rstrip('/')}/grid-{uuid.uuid4().hex}"

    def terms(found: pa.Table) -> pa.Table:
        found = found.sort_by([("id", "ascending"), ("y", "ascending"), ("fold", "ascending"), ("x", "ascending")]).combine_chunks()
        y, fold = 2 * found.column("y").to_numpy() - 1, found.column("fold").to_numpy()
        words = pa.array([re.findall(WORD, t or "") for t in found.column("x").to_pylist()], pa.list_(pa.string()))
        block = packed(words, y, fold, values, features=features)
        return pa.table({"shard": found.column("shard").slice(0, 1), "n": pa.array([len(y)], pa.int64()), "packed": pa.array([block], pa.binary())})

    try:
        blocks = dealt.groupBy("shard").applyInArrow(terms, "shard int, n long, packed binary")
        blocks = blocks.select("shard", "n", F.call_function(store, F.lit(folder), "shard", "packed").alias("bytes"))
        blocks = sorted((r["shard"], r["n"]) for r in blocks.where("bytes > 0").collect())  # a row a block
        good = _searched(spark, descend, folder, [b for b, _ in blocks], values, features, k) if blocks else {}
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    n = sum(n for _, n in blocks)
    out = [(*combination, right / n) for combination, right in good.items()]
    return spark.createDataFrame(out, "norm string, ngram int, alpha double, max_iter int, penalty string, accuracy double")


def _searched(spark, descend: str, folder: str, blocks: list[int], values: dict[str, list], features: int, k: int) -> dict[tuple, int]:
    """Right answers of all folds by (norm, ngram, alpha, max_iter, penalty)."""
    ngrams, stops, alphas = sorted({*values["ngram"]}), sorted(values["max_iter"]), values["alpha"]
    state = np.random.default_rng(0).bit_generator.state["state"]
    seed = b"".join(state[part].to_bytes(16, "little") for part in ("state", "inc"))
    # Those that take longest come first.
    tasks = [(ngram, penalty, norm, fold) for ngram in ngrams[::-1] for penalty in sorted(values["penalty"], key=NETS.get, reverse=True) for norm in values["norm"] for fold in range(k)]
    args = []
    for ngram, penalty, norm, fold in tasks:
        place = ngrams.index(ngram)
        ints = np.array([place, values["norm"].index(norm) * len(ngrams) + place, fold, features, len(alphas), len(stops), *stops], "<i4")
        args.append(bytearray(ints.tobytes() + seed + np.array([NETS[penalty], *alphas], "<f8").tobytes()))
    own = F.array(*map(F.lit, args))[F.col("id").cast("int")]
    found = spark.range(0, len(tasks), 1, len(tasks)).select("id", F.call_function(descend, F.lit(folder), F.lit(bytearray(np.array(blocks, "<i4").tobytes())), own).alias("good"))
    good: dict[tuple, int] = {}
    for task, right in found.collect():  # a row a task
        ngram, penalty, norm, _ = tasks[task]
        for key, own in zip(((norm, ngram, alpha, stop, penalty) for alpha in alphas for stop in stops), right):
            good[key] = good.get(key, 0) + own
    return good


def best_of(found: DataFrame) -> DataFrame:
    """The row with the largest accuracy; of equal ones the first by its parameters."""
    first = ["norm", "ngram", "alpha", "max_iter", "penalty"]
    row = F.min(F.struct((-F.col("accuracy")).alias("low"), *first)).alias("r")
    return found.agg(row).select(*[F.col(f"r.{c}").alias(c) for c in first], (-F.col("r.low")).alias("accuracy"))
