"""Prompt tagging beyond regex rules: cached tags (P9), clustering (P10) and
the prompt loader (P11)."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import short_hash
from ..session import cut_lineage

FITS_AT_ONCE = 4  # K-means fits of several k that run side by side


def tag_from_cache(df: DataFrame, cache: DataFrame, text_col: str = "text", n: int = 12) -> DataFrame:
    """Tags looked up by the first ``n`` hex chars of the text's sha256 in
    a (hash, tag) cache table — what an LLM tagger reduces to once its
    answers exist. A plain equi join: AQE turns it into a broadcast join when
    the cache is small at runtime."""
    c = cache.select(F.col("hash").alias("_h"), F.col("tag").alias("cached_tag")).dropDuplicates(["_h"])
    return (df.withColumn("_h", short_hash(F.col(text_col), n))
            .join(c, "_h", "left").drop("_h"))


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Prompts from JSON lines; the text is the first of the keys
    prompt, text, content."""
    raw = spark.read.text(path).select(F.expr("try_parse_json(value)").alias("v"))
    text = F.coalesce(*[F.expr(f"try_variant_get(v, '$.{k}', 'string')") for k in ("prompt", "text", "content")])
    return raw.select(text.alias("text")).where(F.col("text").isNotNull())


def preprocess(text):
    t = F.regexp_replace(F.trim(F.lower(text)), r"\s+", " ")
    return F.when(F.length(t) < 3, F.lit("")).otherwise(t)


def tag_cluster(prompts: DataFrame, text_col: str = "text", k: int | None = None,
                k_min: int = 5, k_max: int = 25, seed: int = 42) -> DataFrame:
    """P10: TF-IDF (uni+bigrams, English stop words, min_df 2, max_df 0.95,
    at most 1000 features, L2-normalised) → K-means (seed 42) with k chosen
    by silhouette over k_min..k_max → each cluster named after its top mean
    TF-IDF term (alphanumeric, ≤ 12 chars, else ``cluster{n}``).

    Every stage is a ``pyspark.ml`` estimator over the distributed feature
    table; the only driver-side values are the vocabulary (≤ 1000 terms), the
    cluster centres and the per-k silhouette scores. The fits of several k do
    not depend on each other and run side by side, ``FITS_AT_ONCE`` at a time;
    the chosen one is used as it is."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import (CountVectorizer, IDF, NGram, Normalizer, RegexTokenizer,
                                    SQLTransformer, StopWordsRemover)
    from pyspark.ml.functions import vector_to_array

    d = (prompts.withColumn("_clean", preprocess(F.col(text_col))).where(F.col("_clean") != "")
         .withColumn("prompt_hash", short_hash(F.col(text_col))))
    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol="_clean", outputCol="_tok", pattern=r"\w\w+", gaps=False),
        StopWordsRemover(inputCol="_tok", outputCol="_uni"),
        NGram(n=2, inputCol="_uni", outputCol="_bi"),
        SQLTransformer(statement="SELECT *, concat(_uni, _bi) AS _terms FROM __THIS__"),
        CountVectorizer(inputCol="_terms", outputCol="_tf", vocabSize=1000, minDF=2.0, maxDF=0.95),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="features", p=2.0),
    ])
    model = pipe.fit(d)
    # Cut, as each of the many short jobs of a fit ships its lineage; persisted before, which fixes the partitions.
    made = model.transform(d).select("prompt_hash", text_col, "features").persist()
    feats = cut_lineage(made)
    made.unpersist()
    vocab = model.stages[4].vocabulary
    n = feats.count()

    def fit(kk: int):
        return KMeans(k=kk, seed=seed, featuresCol="features").fit(feats.select("features"))

    def scored(kk: int):
        model = fit(kk)
        pred = model.transform(feats.select("features"))
        if pred.select("prediction").distinct().limit(2).count() < 2:
            return None, model
        return ClusteringEvaluator(featuresCol="features", metricName="silhouette").evaluate(pred), model

    best = None
    if k is None:
        tried = list(range(k_min, min(k_max + 1, n)))
        with ThreadPool(FITS_AT_ONCE) as pool:
            fits = pool.map(inheritable_thread_target(feats.sparkSession)(scored), tried, chunksize=1)
        scores = {kk: (score, model) for kk, (score, model) in zip(tried, fits) if score is not None and score > -2.0}
        k = max(scores, key=lambda kk: (scores[kk][0], -kk), default=k_min)
        best = scores[k][1] if k in scores and k <= n else None
    pred = (best or fit(max(1, min(k, n)))).transform(feats)
    from pyspark.ml.stat import Summarizer
    # mean TF-IDF vector per cluster: a (partial) aggregate, never a collected group
    sums = (pred.groupBy("prediction").agg(Summarizer.mean(F.col("features")).alias("_mean"))
            .withColumn("_sum", vector_to_array(F.col("_mean"))))
    top_score = F.array_max("_sum")
    top_idx = F.array_position("_sum", top_score)
    vocab_arr = F.array(*[F.lit(v) for v in vocab]) if vocab else F.array().cast("array<string>")
    term = F.when(top_score > 0, F.element_at(vocab_arr, top_idx.cast("int")))
    name = F.lower(F.substring(F.regexp_replace(term, r"[^\p{L}\p{N}]", ""), 1, 12))
    names = sums.select("prediction", F.when(F.length(name) >= 3, name)
                        .otherwise(F.format_string("cluster%d", "prediction")).alias("tag"))
    out = pred.join(names, "prediction").select("prompt_hash", text_col, F.col("prediction").alias("cluster"), "tag")
    return out
