"""Point clouds as long tables: cloud_id, point_id, x, y, z and whatever other columns they have."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .measures import table_op

AXES = ("x", "y", "z")


@table_op("pointcloud_boundingbox", "pointcloud", "min_x min_y min_z max_x max_y max_z center_x center_y center_z size_x size_y size_z")
def bounding_box(pointcloud):
    s = pointcloud.groupBy("cloud_id").agg(*[f(a).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in AXES])
    return s.select("*", *[((F.col(f"min_{a}") + F.col(f"max_{a}")) / 2).alias(f"center_{a}") for a in AXES], *[(F.col(f"max_{a}") - F.col(f"min_{a}")).alias(f"size_{a}") for a in AXES])


@table_op("PointCloudFitMeasure", "pointcloud", "point_count center_x center_y center_z spread_x spread_y spread_z total_spread", has_z=True)
def cloud_fit(pointcloud, has_z):
    s = pointcloud.groupBy("cloud_id").agg(F.count("*").alias("point_count"), *[F.avg(a).alias(f"center_{a}") for a in AXES], *[F.stddev_pop(a).alias(f"spread_{a}") for a in AXES])
    return s.withColumn("total_spread", F.sqrt(sum((F.col(f"spread_{a}") ** 2 for a in AXES[1:]), F.col("spread_x") ** 2)))


def rotation(rx: float, ry: float, rz: float) -> list[list[float]]:
    """Turn about x, then y, then z, in degrees."""
    (a, b), (c, d), (e, f) = ((math.cos(math.radians(v)), math.sin(math.radians(v))) for v in (rx, ry, rz))
    return [[e * c, e * d * b - f * a, e * d * a + f * b], [f * c, f * d * b + e * a, f * d * a - e * b], [-d, c * b, c * a]]


@table_op("pointcloud_transform", "pointcloud", "x y z", "ShapeModel3DTransform", tx=0.0, ty=0.0, tz=0.0, rx=0.0, ry=0.0, rz=0.0)
def transform(pointcloud, tx, ty, tz, rx, ry, rz):
    """A projection: no shuffle, all other columns stay."""
    m = rotation(rx, ry, rz)
    return pointcloud.withColumns({a: sum((F.col(b) * m[k][j] for j, b in enumerate(AXES)), F.lit(float(t))) for k, (a, t) in enumerate(zip(AXES, (tx, ty, tz), strict=True))})


def _cell(size: float) -> list:
    return [F.floor(F.col(a) / size).alias("c" + a) for a in AXES]


@table_op("PointCloudDownsample", "pointcloud", "cloud_id x y z n", "pcl_pointcloud_downsample", voxel_size=0.01)
def voxel_downsample(pointcloud, voxel_size):
    """The mean point of each voxel: partial sums on the map side, one row a voxel afterwards."""
    return pointcloud.groupBy("cloud_id", *_cell(voxel_size)).agg(*[F.avg(a).alias(a) for a in AXES], F.count("*").alias("n"))


@table_op("pointcloud_merge", "cloud1 cloud2", "x y z")
def merge(cloud1, cloud2):
    return cloud1.unionByName(cloud2, allowMissingColumns=True)


@table_op("multiview_merge", "clouds", "x y z", overlap_threshold=0.1)
def multiview_merge(clouds, overlap_threshold):
    """One point a voxel: that of the least cloud, then point id."""
    first = F.min(F.struct("cloud_id", "point_id", *AXES)).alias("p")
    return clouds.groupBy(*_cell(overlap_threshold)).agg(first).select("p.*")


@table_op("pointcloud_sample", "pointcloud", "x y z", sample_ratio=0.5, method=0)
def sample(pointcloud, sample_ratio, method):
    """Points whose hashed id falls under the ratio: no order is needed, reruns agree."""
    return pointcloud.filter(F.pmod(F.col("point_id") * 7919 + F.col("cloud_id") * 104729, F.lit(10007)) < F.lit(int(sample_ratio * 10007)))


def neighbours(pointcloud: DataFrame, radius: float) -> DataFrame:
    """(cloud_id, point_id, other, distance): pairs within the radius, the point itself included.

    Both sides are keyed by cells as wide as the radius; one side stands in its 27 neighbouring cells, so
    the range join is an equi-join.
    """
    here = pointcloud.select("cloud_id", "point_id", *AXES, *_cell(radius))
    cells = F.explode(F.array(*[F.struct(*[F.lit(v).alias("d" + a) for a, v in zip(AXES, d, strict=True)]) for d in ((i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1))]))
    spread = here.withColumn("d", cells).select("cloud_id", F.col("point_id").alias("other"), *[F.col(a).alias("o" + a) for a in AXES], *[(F.col("c" + a) + F.col("d.d" + a)).alias("c" + a) for a in AXES])
    gap = F.sqrt(sum(((F.col(a) - F.col("o" + a)) ** 2 for a in AXES[1:]), (F.col("x") - F.col("ox")) ** 2))
    return here.join(spread, ["cloud_id", "cx", "cy", "cz"]).withColumn("distance", gap).filter(F.col("distance") <= radius)


@table_op("pointcloud_smooth", "pointcloud", "cloud_id point_id x y z", search_radius=0.03)
def smooth(pointcloud, search_radius):
    near = neighbours(pointcloud, search_radius)
    return near.groupBy("cloud_id", "point_id").agg(*[F.avg("o" + a).alias(a) for a in AXES])


@table_op("PointCloudFilter", "pointcloud", "cloud_id point_id x y z", "pcl_pointcloud_filter", method=1, mean_k=50, std_threshold=1.0, radius=0.05, min_neighbors=5, voxel_size=0.01)
def radius_filter(pointcloud, method, mean_k, std_threshold, radius, min_neighbors, voxel_size):
    """Method 0: mean distance to neighbours within the radius, against the cloud's mean and deviation; 1: enough neighbours; 2: voxels."""
    if method == 2:
        return voxel_downsample(pointcloud, voxel_size)
    near = neighbours(pointcloud, radius).filter(F.col("point_id") != F.col("other"))
    if method == 1:
        keep = near.groupBy("cloud_id", "point_id").agg(F.count("*").alias("k")).filter(F.col("k") >= min_neighbors)
    else:
        order = Window.partitionBy("cloud_id", "point_id").orderBy("distance", "other")
        mean = near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= mean_k).groupBy("cloud_id", "point_id").agg(F.avg("distance").alias("k"))
        limit = mean.groupBy("cloud_id").agg((F.avg("k") + F.stddev_pop("k") * std_threshold).alias("limit"))
        keep = mean.join(limit, "cloud_id").filter(F.col("k") <= F.col("limit"))
    return pointcloud.join(keep.select("cloud_id", "point_id"), ["cloud_id", "point_id"], "left_semi")


@table_op("depth_to_pointcloud", "depth", "cloud_id point_id x y z", "PointCloudFromDepth", "pcl_pointcloud_from_depth", "pointcloud_stereo", depth_scale=1.0, focal_length_x=525.0, focal_length_y=525.0, center_x=0.0, center_y=0.0)
def from_depth(depth, depth_scale, focal_length_x, focal_length_y, center_x, center_y):
    """Pixels (frame_id, y, x, v) with a depth over 0, through a pinhole."""
    z = F.col("v") * depth_scale
    rows = depth.filter(z > 0).select(F.col("frame_id").alias("cloud_id"), (F.col("y").cast("long") * 1_000_000 + F.col("x")).alias("point_id"), ((F.col("x") - center_x) * z / focal_length_x).alias("px"), ((F.col("y") - center_y) * z / focal_length_y).alias("py"), z.cast("double").alias("z"))
    return rows.select("cloud_id", "point_id", F.col("px").alias("x"), F.col("py").alias("y"), "z")


@table_op("pointcloud_outlier", "pointcloud", "cloud_id point_id x y z", neighbors=20, std_threshold=1.0, radius=0.5)
def outliers(pointcloud, neighbors, std_threshold, radius):
    """Points whose mean distance to their nearest neighbours is within the cloud's mean plus deviations; a point with
    none in the radius is one.
    """
    return radius_filter(pointcloud, 0, neighbors, std_threshold, radius, 0, 1.0)


@table_op("scan_merge", "scan_lines", "x y z", line_distance=0.01)
def scan_merge(scan_lines, line_distance):
    """Each scan stands `line_distance` further along y."""
    return scan_lines.withColumn("y", F.col("y") + F.col("scan_index") * line_distance)
