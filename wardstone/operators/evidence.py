"""Evidence of a check: regions of a frame, transcripts, sound, frames and processes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clamp, r4, region_key
from .scan import rolling, run_of


def box_of(xs: Column, ys: Column, width: Column, height: Column) -> Column:
    """Bounding box of a polygon as shares of the frame: x0, y0, x1, y1."""
    side = lambda f, v, size: r4(clamp(f(v).cast("double") / size))
    return F.struct(side(F.array_min, xs, width).alias("x0"), side(F.array_min, ys, height).alias("y0"), side(F.array_max, xs, width).alias("x1"), side(F.array_max, ys, height).alias("y1"))


def region(text: Column, conf: Column) -> tuple[Column, Column]:
    return F.substring(text, 1, 120), r4(conf, 3)


def from_tile(v: Column, tile: Column, grid: Column, overlap: Column) -> Column:
    """A place within a tile (0..1) as a place in the frame: tiles of equal size share ``overlap`` of a tile."""
    size = 1.0 / (grid - (grid - 1) * overlap)
    return r4(clamp((tile * (1 - overlap) + v) * size))


def iou(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Intersection over union of two boxes (x0, y0, x1, y1); 0 without area."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


SIDES = ("x0", "y0", "x1", "y1")


def overlaps(regions: DataFrame, least: float = 0.1) -> DataFrame:
    """Pairs of regions of a frame that overlap and have one text, but for case and white space: (frame_id, ord_a, ord_b, iou)."""
    keyed = regions.withColumn("__key", region_key(F.col("text")))
    a, b = keyed.alias("a"), keyed.alias("b")
    pairs = a.join(b, (F.col("a.frame_id") == F.col("b.frame_id")) & (F.col("a.__key") == F.col("b.__key")) & (F.col("a.ord") < F.col("b.ord")))
    value = iou([F.col(f"a.{s}") for s in SIDES], [F.col(f"b.{s}") for s in SIDES])
    return pairs.select(F.col("a.frame_id").alias("frame_id"), F.col("a.ord").alias("ord_a"), F.col("b.ord").alias("ord_b"), value.alias("iou")).where(F.col("iou") >= least)


def deduped(regions: DataFrame, least: float = 0.1) -> DataFrame:
    """Greedy by order: a region that overlaps a kept one of its text (but for case and white space) replaces it, in its place,
    if its confidence is higher; blank texts go. A frame's regions are one array, which is bounded by what a screen shows."""
    item = F.struct("ord", "text", *SIDES, F.coalesce("conf", F.lit(0.0)).alias("conf"), region_key(F.col("text")).alias("key"))
    frames = regions.where(region_key(F.col("text")) != "").groupBy("frame_id").agg(F.array_sort(F.collect_list(item)).alias("all"))
    kind = f"array<struct<ord:{dict(regions.dtypes)['ord']},text:string,x0:double,y0:double,x1:double,y1:double,conf:double,key:string>>"

    def add(kept: Column, x: Column) -> Column:
        meets = lambda k: (k["key"] == x["key"]) & (iou([k[s] for s in SIDES], [x[s] for s in SIDES]) >= least)
        hit = F.array_position(F.transform(kept, meets), True)
        swapped = F.transform(kept, lambda k, i: F.when((i + 1 == hit) & (x["conf"] > k["conf"]), x).otherwise(k))
        return F.when(hit == 0, F.concat(kept, F.array(x))).otherwise(swapped)

    kept = F.aggregate(F.col("all").cast(kind), F.array().cast(kind), add)
    return frames.select("frame_id", F.posexplode(kept).alias("slot", "r")).select("frame_id", "slot", "r.*").drop("key")


def reading_order(regions: DataFrame) -> DataFrame:
    """Texts of a frame from top to bottom, then left to right."""
    item = F.struct(F.round(F.col("y0").cast("decimal(18,8)"), 2).alias("row"), "x0", "ord", "text")
    return regions.groupBy("frame_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda r: r["text"]), " ").alias("text"))


def top_evidence(regions: DataFrame, most: int = 120) -> DataFrame:
    """Pictures always first, then texts by score and length; at most ``most`` a frame."""
    picture = F.col("kind") == "picture"
    order = Window.partitionBy("frame_id").orderBy(picture.desc(), F.desc("score"), F.desc(F.length(F.trim("text"))), "ord")
    return regions.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def tier(score: Column, limit: Column) -> Column:
    """Risk tier of a region against the age's threshold."""
    return F.when(score >= limit, "high").when(score >= limit * 0.6, "medium").otherwise("low")


def transcripts(segments: DataFrame, clip: str = "clip", order: str = "event_id") -> DataFrame:
    """Heard segments of a clip in order; silence and guesses go."""
    heard = segments.where((F.col("no_speech_prob") <= 0.6) & (F.col("avg_logprob") >= -1.0))
    texts = F.transform(F.array_sort(F.collect_list(F.struct(order, F.trim("text").alias("text")))), lambda s: s["text"])
    return heard.groupBy(clip).agg(F.array_join(F.filter(texts, lambda t: t != ""), " ").alias("transcript"))


def sound_gate(chunks: DataFrame, device: str = "device_id", rows: int = 12, least: float = 0.012) -> DataFrame:
    """Root mean square over the last three seconds of quarter-second chunks, and whether it is sound."""
    found = rolling(chunks, device, ["seq"], run_of(F.col("seq")), rows, {"__squares": F.sum("sumsq"), "__samples": F.sum("n")})
    return found.withColumn("rms", F.sqrt(F.col("__squares") / F.col("__samples"))).withColumn("loud", F.col("rms") >= least).drop("__squares", "__samples")


def with_before(df: DataFrame, group: str, order: str, column: str, name: str, width: int = 1024) -> DataFrame:
    """Adds ``name``: the column's value in the group's row before, by a whole number ``order``. Rows are parted by runs of
    ``width`` numbers, and the last row of each run is also dealt to the group's next run, so no group is one task's."""
    run = F.floor(F.col(order) / width)
    ends = df.groupBy(group, run.alias("__run")).agg(F.max(order).alias("__end"))
    # ends are one row for each run; a group's runs stay within ranges of runs, whose ends are a row each again
    far = F.floor(F.col("__run") / width)
    inside = Window.partitionBy(group, "__far").orderBy("__run")
    firsts = ends.groupBy(group, far.alias("__far")).agg(F.min("__run").alias("__first"))
    firsts = firsts.select(group, "__far", F.lead("__first").over(Window.partitionBy(group).orderBy("__far")).alias("__wrap"))
    nexts = ends.withColumn("__far", far).withColumn("__lead", F.lead("__run").over(inside)).join(firsts, [group, "__far"])
    nexts = nexts.select(F.col(group).alias("__group"), F.col("__end"), F.coalesce("__lead", "__wrap").alias("__run")).where("__run is not null")
    copies = df.join(nexts, (F.col(group) == F.col("__group")) & (F.col(order) == F.col("__end")))
    dealt = df.select("*", run.alias("__run"), F.lit(False).alias("__copy")).union(copies.select(*df.columns, "__run", F.lit(True)))
    before = F.lag(column).over(Window.partitionBy(group, "__run").orderBy(F.desc("__copy"), order))
    return dealt.withColumn(name, before).where(~F.col("__copy")).drop("__run", "__copy")


def scene_change(frames: DataFrame, group: str, order: str, pixels: str) -> DataFrame:
    """Mean absolute difference from the frame before, in percent of 255; the first frame has 0."""
    change = F.aggregate(F.zip_with(pixels, "__before", lambda a, b: F.abs(a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    found = with_before(frames, group, order, pixels, "__before")
    return found.withColumn("change", F.when(F.col("__before").isNull(), 0.0).otherwise(r4(change / F.size(pixels) / 255 * 100, 2))).drop("__before")


#: Words of titles that speak for a sort of frame, or against it.
TITLES = {
    "adult": ["sexual", "nude", "nudity", "porn", "adult", "nsfw", "sex"],
    "weapon": ["gun", "weapon", "knife", "sword", "pistol", "rifle", "shoot", "guns", "knives"],
    "violence": ["combat", "battle", "fight", "match", "violence", "wrestling", "boxing", "assault"],
    "cooking": ["cook", "kitchen", "chef", "food", "spoon", "recipe"],
    "dancing": ["dance", "dancing", "party", "ball", "crowd", "sports"],
}


def frame_scores(title: Column, skin: Column, motion: Column, has_person: Column, long_shape: Column, has_bottle: Column, words: dict[str, list[str]] = TITLES) -> dict[str, Column]:
    """Rule scores of a frame from its title and features. Dancing lifts adult and violent titles, cooking armed ones, and
    either the skin rule, which asks for no person."""
    t = F.lower(F.coalesce(title, F.lit("")))
    named = {k: F.exists(F.lit(v), lambda w: F.contains(t, w)) for k, v in words.items()}
    nsfw = F.when(named["adult"] & ~named["dancing"], 0.89).when((skin > 0.35) & ~named["dancing"] & ~named["cooking"], 0.84).otherwise(0.12)
    weapon = F.when(named["weapon"] & ~named["cooking"], 0.91).when((long_shape | has_bottle) & has_person & ~named["cooking"], 0.81).otherwise(0.15)
    violence = F.when(named["violence"] & ~named["dancing"], 0.94).when((motion > 12) & has_person & ~named["dancing"], 0.83).otherwise(0.05)
    return {"nsfw": nsfw, "weapons": weapon, "violence": violence}


def frame_threat(nsfw: Column, violence: Column, weapons: Column) -> Column:
    """The sort whose score over its limit is the highest, the earlier of equals; ``none`` if there is none."""
    rows = [(nsfw, 0.80, "adult_content"), (violence, 0.80, "violence"), (weapons, 0.75, "weapons")]
    over = F.array_compact(F.array(*[F.when(s > limit, F.struct((-s).alias("key"), F.lit(i).alias("place"), F.lit(n).alias("name"))) for i, (s, limit, n) in enumerate(rows)]))
    return F.coalesce(F.get(F.array_sort(over), 0)["name"], F.lit("none"))


def objects(found: Column, least: float = 0.40) -> Column:
    """Detections above a confidence, boxes as x, y, width, height."""
    fit = F.filter(found, lambda o: o["conf"] > least)
    return F.transform(fit, lambda o: F.struct(o["label"].alias("label"), o["conf"].alias("conf"), o["x0"].alias("x"), o["y0"].alias("y"), (o["x1"] - o["x0"]).alias("w"), (o["y1"] - o["y0"]).alias("h")))


#: Parts of paths of temporary folders and of usual ones for browsers, and the browsers' names.
ODD_PLACES = ["/tmp", "/shared", "temp", "public"]
USUAL_PLACES = ["/Applications", "Program Files", "WindowsApps", "/System", "/usr/bin"]
BROWSERS = ["chrome", "safari", "firefox", "msedge", "opera", "brave"]


def process_flags(processes: DataFrame, most: int = 40) -> DataFrame:
    """Processes from temporary or shared folders, and browsers outside their usual ones (the reason given of both); the odd
    first, then browsers, then by number. Null names and paths count as empty; without a path nothing is odd."""
    name, exe = (F.coalesce(c, F.lit("")) for c in ("name", "exe"))
    holds = lambda text, parts: F.exists(F.lit(parts), lambda p: F.contains(text, p))
    browser = holds(F.lower(name), BROWSERS)
    astray = browser & (exe != "") & ~holds(exe, USUAL_PLACES)
    reason = F.when(astray, "Browser binary running from non-standard directory").when(holds(F.lower(exe), ODD_PLACES), "Running from temporary/shared directory")
    rows = processes.withColumn("is_browser", browser).withColumn("reason", reason).withColumn("is_anomaly", F.col("reason").isNotNull())
    return rows.orderBy(F.desc("is_anomaly"), F.desc("is_browser"), "pid").limit(most)


#: Words of a window's title that tell of a film, and of one that fills the screen.
PLAYING = ["youtube", "netflix", "video", "vlc", "play", "movie", "combat", "match", "mp4"]
FULLSCREEN = ["combat", "match", "battle", "fullscreen"]
NO_MEDIA = "No active media session detected"


def media_flags(title: Column, playing: list[str] = PLAYING, fullscreen: list[str] = FULLSCREEN) -> Column:
    """Whether a window's title says that something plays and, only then, that it fills the screen; the title while it plays."""
    t = F.lower(F.coalesce(title, F.lit("")))
    has = lambda words: F.exists(F.lit(words), lambda w: F.contains(t, w))
    return F.struct(has(playing).alias("playing"), (has(playing) & has(fullscreen)).alias("fullscreen"), F.when(has(playing), title).otherwise(NO_MEDIA).alias("title"))


def frame_log(events: DataFrame, key: str, order: str, most: int = 20) -> DataFrame:
    """Each record's last state, newest first, at most ``most`` for each device."""
    last = events.groupBy("device_id", key).agg(F.max_by(F.struct("*"), order).alias("r")).select("r.*")
    rank = F.row_number().over(Window.partitionBy("device_id").orderBy(F.desc(order)))
    return last.withColumn("rank", rank).where(F.col("rank") <= most)


def dominant_picture(cells: DataFrame, rows: int, cols: int, width: int, height: int) -> DataFrame:
    """(frame_id, x0, y0, x1, y1) of the picture that stands out of a frame's grid of cells, or no row.

    Cells (frame_id, row, col, interest, sat) above a threshold of the frame join into blobs; a frame's grid is a few
    hundred cells. Four or more blobs of nearly the largest one's size (itself included) are a gallery and give none, and so
    does a blob of too few or too many cells, a grey one, or one whose box is smaller than 48 pixels a side.
    """
    import numpy as np
    import pandas as pd

    def of_frame(df: pd.DataFrame) -> pd.DataFrame:
        interest, sat = np.zeros((rows, cols)), np.zeros((rows, cols))
        interest[df["row"], df["col"]], sat[df["row"], df["col"]] = df["interest"], df["sat"]
        hot = interest > max(interest.mean() + 0.6 * interest.std(), 0.10)
        left, blobs = {(int(r), int(c)) for r, c in zip(*np.nonzero(hot), strict=True)}, []
        while left:
            todo, blob = [min(left)], []
            left.discard(todo[0])
            while todo:
                r, c = todo.pop()
                blob.append((r, c))
                near = {(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)} & left
                left -= near
                todo += near
            blobs.append(blob)
        blobs.sort(key=len, reverse=True)  # the first found of equal ones stays first
        out = []
        if blobs and sum(len(b) >= 0.45 * len(blobs[0]) for b in blobs) < 4 and 0.04 <= len(blobs[0]) / (rows * cols) <= 0.92:
            r, c = np.array(blobs[0]).T
            box = [max(0, c.min() / cols - 0.02), max(0, r.min() / rows - 0.02), min(1, (c.max() + 1) / cols + 0.02), min(1, (r.max() + 1) / rows + 0.02)]
            sides = int(box[2] * width) - int(box[0] * width), int(box[3] * height) - int(box[1] * height)
            if sat[r, c].mean() >= 0.12 and min(sides) >= 48 and min(width, height) >= 64:
                out = [(int(df["frame_id"].iloc[0]), *map(float, box))]
        return pd.DataFrame(out, columns=["frame_id", "x0", "y0", "x1", "y1"])

    return cells.groupBy("frame_id").applyInPandas(of_frame, "frame_id long, x0 double, y0 double, x1 double, y1 double")
