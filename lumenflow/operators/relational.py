"""Operators over records: synchronisation, performance, labels, data sets, formatting."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .measures import table_op


@table_op("FrameSyncCheck", "frames", "n spread_us sync_offset sync_status", key="frame_id", time="capture_time_us", tolerance_us=1000.0)
def frame_sync(frames, key, time, tolerance_us):
    """Cameras of one trigger: in sync if their times differ by the tolerance at most; the offset is the
    mean distance to the whole mean time, 0 for fewer than two frames.
    """
    t = F.col(time)
    mean = frames.groupBy(key).agg(F.count(t).alias("n"), (F.max(t) - F.min(t)).alias("spread_us"), F.floor(F.expr(f"sum(`{time}`) div count(`{time}`)")).alias("mean"))
    off = frames.join(mean.select(key, "mean"), key).groupBy(key).agg((F.sum(F.abs(t - F.col("mean"))) / F.count(t)).alias("offset"))
    return mean.join(off, key).select(key, "n", "spread_us", F.when(F.col("n") < 2, 0.0).otherwise(F.col("offset")).alias("sync_offset"), (F.col("spread_us") <= tolerance_us).alias("sync_status"))


@table_op("TimestampAlign", "frames references", "aligned_timestamp time_offset", key="source_id", time="ts", bucket="none", clock_source="system")
def timestamp_align(frames, references, key, time, bucket, clock_source):
    """With a clock other than `system`, only references of that clock_source (a column of theirs) count. As-of: each frame takes the latest reference at or before it, of its own key. Both tables are merged and
    carried forward in one ordered window, so no range join is needed.
    """
    if clock_source != "system":
        references = references.filter(F.col("clock_source") == clock_source)
    a = frames.select("*", F.lit(1).alias("__side"), F.lit(None).cast(references.schema[time].dataType).alias("__ref"))
    b = references.select(F.col(key), F.col(time), F.lit(0).alias("__side"), F.col(time).alias("__ref"))
    w = Window.partitionBy(key).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    merged = a.unionByName(b, allowMissingColumns=True).withColumn("aligned_timestamp", F.last("__ref", ignorenulls=True).over(w))
    return merged.filter("__side = 1").drop("__side", "__ref")


@table_op("PerformanceAnalyzer", "runs", "runs errors total_us min_us max_us avg_us share error_rate bottleneck rank", key="node_id", duration="duration_us", success="success", bottleneck_share=10.0)
def performance(runs, key, duration, success, bottleneck_share):
    """Per node; a bottleneck takes its share of all time or fails more than one run in ten. Only one row per node is ranked."""
    s = runs.groupBy(key).agg(F.count("*").alias("runs"), F.count_if(~F.col(success)).alias("errors"), F.sum(duration).alias("total_us"), F.min(duration).alias("min_us"), F.max(duration).alias("max_us"), F.avg(duration).alias("avg_us"))
    share = F.col("total_us") * 100.0 / F.sum("total_us").over(Window.partitionBy())
    s = s.select("*", share.alias("share"), (F.col("errors") * 1.0 / F.col("runs")).alias("error_rate"))
    return s.select("*", ((F.col("share") >= bottleneck_share) | (F.col("error_rate") > 0.1)).alias("bottleneck"), F.row_number().over(Window.orderBy(F.desc("avg_us"), key)).alias("rank"))


@table_op("DatasetSplit", "dataset", "split", key="image_id", train_ratio=0.7, val_ratio=0.15, test_ratio=0.15, stratified=False, label="label", random_seed=42)
def dataset_split(dataset, key, train_ratio, val_ratio, test_ratio, stratified, label, random_seed):
    """By a hash of the key: the same row always falls into the same part, and no order is needed. Ratios are shares of
    their sum. Stratified, each label's rows are cut in the order of the hash, so that every label has the shares.
    """
    whole = train_ratio + val_ratio + test_ratio
    train_ratio, val_ratio = train_ratio / whole, val_ratio / whole
    if stratified:
        rank = F.percent_rank().over(Window.partitionBy(label).orderBy(F.xxhash64(key, F.lit(int(random_seed))), key))
        return dataset.withColumn("split", F.when(rank < train_ratio, "train").when(rank < train_ratio + val_ratio, "val").otherwise("test"))
    u = F.pmod(F.col(key) * 7919 + int(random_seed), F.lit(1000))
    return dataset.withColumn("split", F.when(u < round(train_ratio * 1000), "train").when(u < round((train_ratio + val_ratio) * 1000), "val").otherwise("test"))


@table_op("ModelEvaluate", "predictions", "accuracy macro_precision macro_recall macro_f1 total", truth="gt", predicted="pred", num_classes=2, task_type="classification", average_method="macro", confidence="", confidence_threshold=0.5, iou="", iou_threshold=0.5)
def model_evaluate(predictions, truth, predicted, num_classes, task_type, average_method, confidence, confidence_threshold, iou, iou_threshold):
    """From the confusion counts, one row a class; macro averages are over the declared number of classes, weighted ones by
    the classes' true rows. Predictions under the confidence threshold, and for detection those that overlap their
    truth by less than iou_threshold, count as of no class, where the columns are named.
    """
    if confidence:
        predictions = predictions.withColumn(predicted, F.when(F.col(confidence) >= confidence_threshold, F.col(predicted)).otherwise(-1))
    if task_type == "detection" and iou:
        predictions = predictions.withColumn(predicted, F.when(F.col(iou) >= iou_threshold, F.col(predicted)).otherwise(-1))
    t, p = F.col(truth), F.col(predicted)
    each = predictions.select(t.alias("t"), p.alias("p")).groupBy("t", "p").agg(F.count("*").alias("n"))
    sides = each.select(F.explode(F.array(F.struct(F.col("t").alias("k"), F.col("n").alias("gt"), F.lit(0).cast("long").alias("pr"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("p").alias("k"), F.lit(0).cast("long").alias("gt"), F.col("n").alias("pr"), F.lit(0).cast("long").alias("tp")))).alias("s")).select("s.*")
    per = sides.groupBy("k").agg(F.sum("gt").alias("gt"), F.sum("pr").alias("pr"), F.sum("tp").alias("tp")).filter(F.col("k").between(0, num_classes - 1))
    pre, rec = F.when(F.col("pr") > 0, F.col("tp") / F.col("pr")).otherwise(0.0), F.when(F.col("gt") > 0, F.col("tp") / F.col("gt")).otherwise(0.0)
    f1 = F.when(pre + rec > 0, pre * rec * 2 / (pre + rec)).otherwise(0.0)
    total = F.sum("gt")
    if average_method == "weighted":
        mean = lambda v: F.sum(v * F.col("gt")) / total
        return per.agg((F.sum("tp") / total).alias("accuracy"), mean(pre).alias("macro_precision"), mean(rec).alias("macro_recall"), mean(f1).alias("macro_f1"), total.alias("total"))
    return per.agg((F.sum("tp") / total).alias("accuracy"), (F.sum(pre) / num_classes).alias("macro_precision"), (F.sum(rec) / num_classes).alias("macro_recall"), (F.sum(f1) / num_classes).alias("macro_f1"), total.alias("total"))


@table_op("LabelMerge", "labels_a labels_b", "labels", key="image_id", merge_mode="union", resolve_conflict="keep_all")
def label_merge(labels_a, labels_b, key, merge_mode, resolve_conflict):
    """A union keeps different rows of one key, or with keep_first those of the first table, with keep_last of the second."""
    if merge_mode == "union" and resolve_conflict in ("keep_first", "keep_last"):
        a, b = (labels_a, labels_b) if resolve_conflict == "keep_first" else (labels_b, labels_a)
        return a.unionByName(b.join(a.select(key).distinct(), key, "left_anti"), allowMissingColumns=True).distinct()
    if merge_mode == "intersection":
        return labels_a.join(labels_b.select(key).distinct(), key, "left_semi")
    if merge_mode == "difference":
        return labels_a.join(labels_b.select(key).distinct(), key, "left_anti")
    return labels_a.unionByName(labels_b, allowMissingColumns=True).distinct()


@table_op("DataFormat", "data", "output", value="data", format="{}", prefix="", suffix="")
def data_format(data, value, format, prefix, suffix):
    return data.withColumn("output", F.concat(F.lit(prefix), F.replace(F.lit(format), F.lit("{}"), F.coalesce(F.col(value).cast("string"), F.lit(""))), F.lit(suffix)))


@table_op("ResultOutput", "data", "output", value="data", output_format="text", label="Result")
def result_output(data, value, output_format, label):
    v = F.col(value)
    return data.withColumn("output", F.to_json(F.struct(F.lit(label).alias("label"), v.alias("value"))) if output_format == "json" else F.concat(F.lit(label + ": "), v.cast("string")))


@table_op("OCRVerify", "texts", "distance similarity match", text="text", expected="expected", min_similarity=0.9, ignore_case=False, case_sensitive=True, char_set="", confidence="", confidence_threshold=50.0)
def ocr_verify(texts, text, expected, min_similarity, ignore_case, case_sensitive, char_set, confidence, confidence_threshold):
    """Where a column of confidences is named, texts under the threshold match nothing."""
    a, b = (F.lower(F.col(c)) if ignore_case or not case_sensitive else F.col(c) for c in (text, expected))
    d = F.levenshtein(a, b)
    longest = F.greatest(F.length(a), F.length(b))
    s = F.when(longest > 0, 1 - d / longest).otherwise(1.0)
    sure = F.col(confidence) >= confidence_threshold if confidence else F.lit(True)
    return texts.select("*", d.alias("distance"), s.alias("similarity"), ((s >= min_similarity) & sure).alias("match"))


@table_op("MeasureResultsGet", "results", "values", object_id="", key="object_id")
def results_get(results, object_id, key):
    return results.filter(F.col(key) == object_id) if object_id else results


@table_op("CalibrationHistory", "offsets", "history_count last_offset_x last_offset_y", key="camera_id", time="ts", max_history=100)
def calibration_history(offsets, key, time, max_history):
    """The latest `max_history` offsets of each camera, and the last of them."""
    w = Window.partitionBy(key).orderBy(F.desc(time))
    kept = offsets.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= max_history)
    last = lambda c: F.max(F.when(F.col("__r") == 1, F.col(c)))
    return kept.groupBy(key).agg(F.count("*").alias("history_count"), last("offset_x").alias("last_offset_x"), last("offset_y").alias("last_offset_y"))
