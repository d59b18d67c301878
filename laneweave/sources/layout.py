"""Map elements laid out by place, so that a selection reads the folders and row groups around its boxes only.

The world is halved in both directions at each level. An element belongs to
the finest level whose cells are no narrower than its own box and to the cell
of its south-west corner there, so the box never reaches beyond the next cell
to the east and north. An area meets it in the coarser of their two levels,
where either covers two cells in a row at most: a box of any width is some
nine cells in each of ``LEVELS`` levels, never a list of all small ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Finest level: cells of some 0.0055 by 0.0027 degrees.
LEVELS = 16
#: Level of the folders of a store, 5461 of all sizes at most.
TILE_LEVEL = 6

STORED = ("tile", "place", "box_south", "box_north", "box_west", "box_east")


def element_box(geometry: Column) -> Column:
    """Smallest box around the points with two finite numbers, as (south, north, west, east); null without any."""
    sound = F.filter(geometry, lambda p: (F.abs(p["lat"]) < float("inf")) & (F.abs(p["lon"]) < float("inf")))
    lat, lon = F.transform(sound, lambda p: p["lat"]), F.transform(sound, lambda p: p["lon"])
    return F.when(F.size(sound) > 0, F.struct(F.array_min(lat).alias("south"), F.array_max(lat).alias("north"), F.array_min(lon).alias("west"), F.array_max(lon).alias("east")))


def _unit(x: Column, span: float) -> Column:
    """Degrees as a share of the world, what lies outside at its edge."""
    return F.least(F.greatest((x + span / 2) / span, F.lit(0.0)), F.lit(1 - 2.0**-20))


def box_level(box: Column) -> Column:
    """Finest level whose cells are as wide and high as the box."""
    extent = F.greatest((box["east"] - box["west"]) / 360.0, (box["north"] - box["south"]) / 180.0)
    # A little wider, so that rounding never makes a box reach a third cell.
    level = -F.ceil(F.log2(F.greatest(extent * (1 + 1e-9), F.lit(2.0**-30))))
    return F.greatest(F.least(level, F.lit(LEVELS)), F.lit(0)).cast("int")


def cell(x: Column, span: float, level: Column) -> Column:
    return F.floor(_unit(x, span) * F.pow(F.lit(2.0), level)).cast("bigint")


def _spread(x: Column) -> Column:
    """Bits of a number below 2**16 moved apart, a zero before each."""
    for by, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = x.bitwiseOR(F.shiftleft(x, by)).bitwiseAND(F.lit(mask).cast("bigint"))
    return x


def curve(x: Column, y: Column) -> Column:
    """Place of a cell along the Z-shaped curve of its level."""
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1))


def tile(x: Column, y: Column, level: Column) -> Column:
    """Number of a cell among those of its level and all coarser ones."""
    return (((F.pow(F.lit(4.0), level) - 1) / 3).cast("bigint") + curve(x, y)).cast("int")


def write_elements(elements: DataFrame, path: str, files: int | None = None) -> None:
    """Write elements that have a point, a folder for each tile, sorted along the curve inside.

    Ranges of (tile, place) go to tasks, so a crowded tile is many files and a
    sparse one shares its task with others; each file's box columns cover a
    small region, which its statistics tell. ``files`` is the number of tasks
    (``spark.sql.shuffle.partitions`` if null). An element column with a name
    of ``STORED`` is a ValueError.
    """
    clash = set(STORED) & {c.lower() for c in elements.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are the store's own")
    placed = elements.withColumn("__box", element_box(F.col("geometry"))).where("__box is not null")
    b = F.col("__box")
    west, south = b["west"], b["south"]
    level = F.least(box_level(b), F.lit(TILE_LEVEL))
    fine = F.lit(LEVELS)
    keyed = placed.withColumns({"tile": tile(cell(west, 360.0, level), cell(south, 180.0, level), level), "place": curve(cell(west, 360.0, fine), cell(south, 180.0, fine))})
    for side in ("south", "north", "west", "east"):
        keyed = keyed.withColumn(f"box_{side}", b[side])
    parts = files or int(elements.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.drop("__box").repartitionByRange(parts, "tile", "place").sortWithinPartitions("tile", "place")
    dealt.write.partitionBy("tile").parquet(path)


def area_boxes(areas: DataFrame) -> DataFrame:
    """(area_id, __area, __level) of the areas with a box; a null or not a number or a wrong order is no box."""
    sides = ("north", "south", "east", "west")
    finite = " and ".join(f"abs({s}) < double('infinity')" for s in sides)
    return areas.where(f"{finite} and south <= north and west <= east").select("area_id", F.struct(*sides).alias("__area")).withColumn("__level", box_level(F.col("__area")))


def _around(area: Column, level: Column) -> Column:
    """Cells of a level whose elements may meet the area: its own and those west and south of it."""
    low = lambda c: F.greatest(c - 1, F.lit(0).cast("bigint"))
    xs = F.sequence(low(cell(area["west"], 360.0, level)), cell(area["east"], 360.0, level))
    ys = F.sequence(low(cell(area["south"], 180.0, level)), cell(area["north"], 180.0, level))
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(x.alias("x"), y.alias("y")))))


def tiles_of(areas: DataFrame) -> list[int]:
    """Tiles that may hold elements of the areas, 5461 at most: the number of all there are."""
    levels = area_boxes(areas).withColumn("__l", F.explode(F.sequence(F.lit(0), F.lit(TILE_LEVEL))))
    cells = levels.withColumn("__c", F.explode(_around(F.col("__area"), F.col("__l"))))
    return sorted(r.tile for r in cells.select(tile(F.col("__c.x"), F.col("__c.y"), F.col("__l")).alias("tile")).distinct().collect())


def read_around(spark: SparkSession, path: str, areas: DataFrame) -> DataFrame:
    """Stored elements that may lie in one of the areas: folders by their tiles, row groups by the box around all areas."""
    stored = spark.read.parquet(path)
    tiles = tiles_of(areas)
    if not tiles:
        return stored.where("false").drop(*STORED)
    hull = area_boxes(areas).agg(F.max("__area.north").alias("n"), F.min("__area.south").alias("s"), F.max("__area.east").alias("e"), F.min("__area.west").alias("w")).first()
    near = F.col("tile").isin(tiles) & (F.col("box_south") <= hull.n) & (F.col("box_north") >= hull.s) & (F.col("box_west") <= hull.e) & (F.col("box_east") >= hull.w)
    return stored.where(near).drop(*STORED)


def meet_areas(elements: DataFrame, areas: DataFrame) -> DataFrame:
    """Elements with each area whose box meets theirs, once a pair, as ``area_id`` and ``__area``.

    Keys of kind 0 bring an element, at its own level, together with areas of
    finer levels. Keys of kind 1 bring it together with areas of one level,
    its own or a coarser one, once for each such level that some area has. So
    an element of a small size never meets all small areas of a wide cell.
    """
    boxes = area_boxes(areas)
    levels = sorted(r[0] for r in boxes.select("__level").distinct().collect())  # LEVELS + 1 numbers at most
    key = lambda kind, level, c: F.struct(F.lit(kind).alias("kind"), level.alias("level"), c["x"].alias("x"), c["y"].alias("y"))
    own, all_levels = F.col("__level"), F.sequence(F.lit(0), F.col("__level"))
    wanted = boxes.withColumn("__l", F.explode(all_levels)).withColumn("__c", F.explode(_around(F.col("__area"), F.col("__l"))))
    wanted = wanted.select("area_id", "__area", key(0, F.col("__l"), F.col("__c")).withField("kind", (F.col("__l") == own).cast("int")).alias("__key"))
    b = F.col("__box")
    at = lambda l: F.struct(cell(b["west"], 360.0, l).alias("x"), cell(b["south"], 180.0, l).alias("y"))
    placed = elements.withColumn("__box", element_box(F.col("geometry"))).where("__box is not null").withColumn("__own", box_level(F.col("__box")))
    coarser = F.filter(F.array(*[F.lit(v) for v in levels]).cast("array<int>"), lambda v: v <= F.col("__own"))
    keys = F.concat(F.array(key(0, F.col("__own"), at(F.col("__own")))), F.transform(coarser, lambda v: key(1, v, at(v))))
    a = F.col("__area")
    touch = (b["south"] <= a["north"]) & (b["north"] >= a["south"]) & (b["west"] <= a["east"]) & (b["east"] >= a["west"])
    return placed.withColumn("__key", F.explode(keys)).join(wanted, "__key").where(touch).select(*elements.columns, "area_id", "__area")
