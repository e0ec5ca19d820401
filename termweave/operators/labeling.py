"""Token and document classifiers by label: perceptron training in shards, and scoring as a join with sparse weights."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import take_after
from .index import cut

#: Examples of a shard, about: what one Python worker holds at once.
SHARD = 1000


def train_perceptron(examples: DataFrame, passes: int = 10, shard: int = SHARD) -> DataFrame:
    """label_id, feature, weight from (label_id, item_id, positive, features: array<string>); the bias has feature null.

    Examples go to shards by the hash of their ids, as many as it takes for about shard of them in each. In each
    pass every shard updates the weights so far sequentially, in the order of ids, over its own examples; the
    shards' weights are then averaged by a sum over features. A label of one shard is trained as in the sequential
    algorithm. A shard is sent only the weights of its own features; training ends when no shard changed any.
    """
    counts = examples.groupBy("label_id").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / shard)).alias("shards"))
    rows = examples.select("label_id", "item_id", F.col("positive").cast("boolean").alias("positive"), F.array_compact("features").alias("features"))
    rows = cut(rows.join(F.broadcast(counts), "label_id").withColumn("shard", F.pmod(F.xxhash64("item_id"), F.col("shards"))))
    own = rows.select("label_id", "shard", F.explode("features").alias("feature")).distinct()
    own = cut(own.unionByName(rows.select("label_id", "shard", F.lit(None).cast("string").alias("feature")).distinct()))
    counts = cut(rows.select("label_id", "shards").distinct())

    def train(rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"label_id": [], "feature": [], "step": []})
        rows = rows.sort_values(["item_id", "positive"], kind="stable")
        weights = {(None if pd.isna(f) else f): w for f, w in zip(start["feature"], start["weight"], strict=True)}
        steps: dict = {}
        for positive, features in zip(rows["positive"], rows["features"], strict=True):
            features = [None, *features]
            if (sum(weights.get(f, 0.0) for f in features) > 0) != bool(positive):
                step = 1.0 if positive else -1.0
                for f in features:
                    weights[f] = weights.get(f, 0.0) + step
                    steps[f] = steps.get(f, 0.0) + step
        # steps of 0 stay: they tell that something changed
        return pd.DataFrame({"label_id": rows["label_id"].iloc[0], "feature": pd.Series(list(steps), dtype="object"), "step": list(steps.values())})

    weights = counts.select("label_id", F.lit(None).cast("string").alias("feature"), F.lit(0.0).alias("weight"))
    for _ in range(passes):
        start = own.join(weights.withColumnsRenamed({"label_id": "l", "feature": "f"}), (F.col("label_id") == F.col("l")) & F.col("feature").eqNullSafe(F.col("f"))).select("label_id", "shard", "feature", "weight")
        steps = rows.groupBy("label_id", "shard").cogroup(start.groupBy("label_id", "shard")).applyInPandas(train, "label_id long, feature string, step double")
        # whole steps add up alike in any order
        steps = cut(steps.groupBy("label_id", "feature").agg(F.sum("step").alias("step")))
        if steps.isEmpty():
            break
        mean = steps.join(F.broadcast(counts), "label_id").select("label_id", "feature", (F.col("step") / F.col("shards")).alias("weight"))
        weights = cut(weights.unionByName(mean).groupBy("label_id", "feature").agg(F.round(F.sum("weight"), 9).alias("weight")))
    return weights.filter("weight <> 0 or feature is null")


def strongest(weights: DataFrame, k: int) -> DataFrame:
    """The k features of the largest weight either way."""
    return weights.filter(F.col("feature").isNotNull()).orderBy(F.desc(F.abs("weight")), "feature").limit(k)


def score(features: DataFrame, weights: DataFrame, after: int | None = None, k: int = 100) -> DataFrame:
    """item_id, score of the k best items from (item_id, feature) and (feature, weight); after resumes behind an id."""
    features = features if after is None else features.filter(F.col("item_id") > after)
    dot = features.join(weights.filter(F.col("feature").isNotNull()), "feature").groupBy("item_id").agg(F.round(F.sum("weight"), 6).alias("score"))
    return dot.orderBy(F.desc("score"), "item_id").limit(k)


def score_all(items: DataFrame, weights: DataFrame) -> DataFrame:
    """item_id, score of every item (item_id, features: array<string>): the bias of (feature, weight) and the weights of its features."""
    told = items.select("item_id", F.explode("features").alias("feature")).join(weights.filter(F.col("feature").isNotNull()), "feature")
    # items without a known feature have their bias alone
    parts = told.select("item_id", "weight").unionByName(items.select("item_id", F.lit(0.0).alias("weight")))
    bias = weights.filter(F.col("feature").isNull()).agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("bias"))
    return parts.groupBy("item_id").agg(F.sum("weight").alias("dot")).join(F.broadcast(bias)).select("item_id", F.round(F.col("dot") + F.col("bias"), 6).alias("score"))


def write_scored_order(items: DataFrame, path: str) -> None:
    """Items (item_id, features) in order of ids, so that a scan from an id on reads only the files and row groups behind it."""
    items.select("item_id", "features").repartitionByRange("item_id").sortWithinPartitions("item_id").write.parquet(path)


def scan(stored: DataFrame, weights: DataFrame, limit: int, k: int = 100, after: int | None = None, best: DataFrame | None = None) -> tuple[DataFrame, int | None]:
    """The next limit items of a table that write_scored_order() wrote, behind the id after (None: from the first on), scored; the k best of
    these and of an earlier scan's best (item_id, score), and the last id scored: what the next scan goes on from. Without items left it is None.

    The filter on ids is pushed down to the scan, of which the limit ends the reading in order of ids.
    """
    rest = stored if after is None else stored.filter(F.col("item_id") > after)
    last = rest.select("item_id").orderBy("item_id").limit(limit).agg(F.max("item_id")).first()[0]
    if last is None:
        none = stored.sparkSession.createDataFrame([], "item_id long, score double")
        return (none if best is None else best), None
    found = score_all(rest.filter(F.col("item_id") <= last), weights)
    found = found if best is None else found.unionByName(best)
    return cut(found.orderBy(F.desc("score"), "item_id").limit(k)), last


def difference_weights(items: DataFrame, judged: DataFrame) -> DataFrame:
    """feature, weight: in how many more positive than negative items (item_id, positive) a feature stands; items: item_id, features (each once)."""
    own = items.join(judged, "item_id").select(F.explode("features").alias("feature"), F.when(F.col("positive"), 1).otherwise(-1).alias("w"))
    return own.groupBy("feature").agg(F.sum("w").alias("weight")).filter("weight <> 0")


def seed_curve(items: DataFrame, judged: DataFrame, sizes: list[int]) -> DataFrame:
    """seeds, item_id, score of every judged item under the difference weights of the first so many seeds, for all sizes in one job; judged: item_id, positive, place (from 1).

    Weights of growing seeds are sums over the steps between sizes, so a feature has a row for each step in which it changes, and an
    item's score of a size is the sum over the steps up to it.
    """
    sizes = sorted(set(sizes))
    step = F.lit(None).cast("int")
    for n in reversed(sizes):
        step = F.when(F.col("place") <= n, n).otherwise(step)
    own = judged.withColumn("step", step)
    told = items.join(own, "item_id").select("item_id", "positive", "step", F.explode("features").alias("feature"))
    changed = told.filter("step is not null").groupBy("feature", "step").agg(F.sum(F.when(F.col("positive"), 1).otherwise(-1)).alias("weight")).filter("weight <> 0")
    parts = told.select("item_id", "feature").join(changed, "feature").groupBy("item_id", "step").agg(F.sum("weight").alias("part"))
    steps = judged.sparkSession.createDataFrame([(n,) for n in sizes], "step int")
    every = judged.select("item_id").crossJoin(F.broadcast(steps)).join(parts, ["item_id", "step"], "left")  # a row for each size of the caller's list
    upto = Window.partitionBy("item_id").orderBy("step")
    return every.select(F.col("step").cast("long").alias("seeds"), "item_id", F.sum(F.coalesce("part", F.lit(0))).over(upto).cast("double").alias("score"))


def strongest_by_size(weights: DataFrame, k: int) -> DataFrame:
    """The k features of the largest weight either way, ties by feature."""
    return weights.orderBy(F.desc(F.abs("weight")), "feature").limit(k)


def svm_rows(items: DataFrame, ids: DataFrame, judged: DataFrame) -> DataFrame:
    """item_id, line: 'label id:1 id:1 ...' in order of ids, from items (item_id, features), ids (term, id) and judged (item_id, label)."""
    told = items.join(judged, "item_id").select("item_id", "label", F.explode("features").alias("term")).join(ids, "term")
    row = F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: F.concat(x.cast("string"), F.lit(":1"))), " ")
    return told.groupBy("item_id", "label").agg(row.alias("f")).select("item_id", F.concat_ws(" ", F.col("label").cast("string"), "f").alias("line"))


def class_names(tag: Column) -> Column:
    """array of kind, name that a microdata tag 'prefix/object:property' stands for: label, and prop if it names a property, else obj; none for a deeper path.

    Without a prefix the whole tag is meant; what stands before a mark <m>: doesn't count.
    """
    useful = take_after(F.lower(take_after(tag, "<m>:")), "/")
    pair = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    more = F.when(useful.contains(":"), pair("prop", take_after(useful, ":"))).otherwise(pair("obj", useful))
    return F.when(useful.contains("/"), F.array().cast("array<struct<kind:string,name:string>>")).otherwise(F.array(pair("label", useful), more))


def class_rows(tokens: DataFrame, ids: DataFrame, least: int = 1000) -> DataFrame:
    """kind, name, class_id, item_id, line: a row of sparse features for each class of each token (item_id, sentence, tags, features).

    Classes that fewer than least tokens have are left out; the others are numbered from 1 in order. A token without a class is
    one of null/near, if its sentence has a tag, else of null/far, and has number 0. Lines are 'class id:1 id:1 ...' in order of ids (term, id); features that have none are left out.
    """
    own = tokens.select("item_id", "sentence", (F.size("tags") > 0).alias("tagged"), F.array_distinct(F.flatten(F.transform("tags", class_names))).alias("classes"), F.array_distinct(F.transform("features", lambda x: F.lower(x))).alias("features"))
    own = cut(own)
    frequent = own.select(F.explode("classes").alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    # as many rows as there are frequent classes
    numbers = cut(frequent.select("c", F.row_number().over(Window.orderBy("c.kind", "c.name")).alias("class_id")))
    near = own.filter("tagged").select("sentence").distinct().withColumn("near", F.lit(True))
    named = own.select("item_id", F.explode("classes").alias("c")).join(F.broadcast(numbers), "c").select("item_id", "c.kind", "c.name", "class_id")
    rest = own.select("item_id", "sentence").join(named.select("item_id").distinct(), "item_id", "left_anti").join(near, "sentence", "left")
    none = rest.select("item_id", F.lit("null").alias("kind"), F.when(F.col("near"), "near").otherwise("far").alias("name"), F.lit(0).alias("class_id"))
    told = own.select("item_id", F.explode("features").alias("term")).join(ids, "term").groupBy("item_id").agg(F.array_sort(F.collect_list("id")).alias("f"))
    rows = named.unionByName(none).join(told, "item_id", "left")
    pairs = F.transform(F.coalesce("f", F.array().cast("array<bigint>")), lambda x: F.concat(x.cast("string"), F.lit(":1")))
    return rows.select("kind", "name", "class_id", "item_id", F.concat_ws(" ", F.col("class_id").cast("string"), pairs).alias("line"))


def judged_features(items: DataFrame, judged: DataFrame) -> DataFrame:
    """feature, positive, negative: in how many judged items of each kind a feature stands."""
    own = items.join(judged, "item_id").select("positive", F.explode("features").alias("feature"))
    return own.groupBy("feature").agg(F.count_if("positive").alias("positive"), F.count_if(~F.col("positive")).alias("negative"))


class Classifier(Protocol):
    """What a classifier of items by features offers: examples are item_id, positive, features; a model is feature, weight (the bias has feature null)."""

    def train(self, examples: DataFrame) -> DataFrame: ...

    def score(self, items: DataFrame, model: DataFrame) -> DataFrame: ...


class Perceptron:
    """Averaged shards of perceptrons."""

    def __init__(self, passes: int = 10):
        self.passes = passes

    def train(self, examples: DataFrame) -> DataFrame:
        return train_perceptron(examples.select(F.lit(1).cast("long").alias("label_id"), "item_id", "positive", "features"), self.passes).select("feature", "weight")

    def score(self, items: DataFrame, model: DataFrame) -> DataFrame:
        return score_all(items, model)


class Difference:
    """Counts of positive less negative items; the features strongest either way."""

    def __init__(self, features: int = 100):
        self.features = features

    def train(self, examples: DataFrame) -> DataFrame:
        weights = difference_weights(examples.select("item_id", "features"), examples.select("item_id", "positive"))
        return strongest_by_size(weights, self.features).select("feature", F.col("weight").cast("double").alias("weight"))

    def score(self, items: DataFrame, model: DataFrame) -> DataFrame:
        return score_all(items, model)


#: Classifiers by name.
CLASSIFIERS: dict[str, type] = {"perceptron": Perceptron, "difference": Difference}
