"""Functions on scenes, images and answers: partitions, tiers, boxes, costs, JSON in prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..scene import let


def partition_of(key: Column, test_fraction: float = 0.2) -> Column:
    """test or dev, by the first 32 bits of the key's SHA-1."""
    bucket = F.pmod(F.conv(F.substring(F.sha1(key.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(1000))
    return F.when(bucket < round(test_fraction * 1000), "test").otherwise("dev")


def difficulty(blur: Column, glare: Column, blur_medium: float = 300.0, blur_hard: float = 100.0, glare_medium: float = 0.05, glare_hard: float = 0.15) -> Column:
    return F.when((blur < blur_hard) | (glare > glare_hard), "hard").when((blur < blur_medium) | (glare > glare_medium), "medium").otherwise("easy")


def source_id(sha256: Column) -> Column:
    return F.concat(F.lit("commons-"), F.substring(sha256, 1, 12))


def clipped(box: list[Column], width: Column, height: Column) -> Column:
    """A box clipped to the image, as a struct; null if nothing is left."""
    x0, y0, x1, y1 = box
    a, b, c, d = F.greatest(x0, F.lit(0)), F.greatest(y0, F.lit(0)), F.least(x1, width), F.least(y1, height)
    return F.when((a < c) & (b < d), F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1")))


def image_scale(width: Column, height: Column, most: int = 2048) -> Column:
    """Original pixels for a pixel of the image as sent, whose longest side is most at most."""
    return F.greatest(F.lit(1.0), F.greatest(width, height) / most)


def cost(stated: Column, tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """What the provider billed, else by prices a thousand tokens; null if a price is missing."""
    return F.coalesce(stated, (tokens_in * price_in + tokens_out * price_out) / 1000)


def json_span(text: Column) -> Column:
    """The outermost {...} of an answer, without a Markdown fence; null if there is none."""
    fence = F.regexp_replace(text, r"(?s)\A\s*```[a-zA-Z]*\s*|\s*```\s*\z", "")

    def span(bare: Column) -> Column:
        first, last = F.instr(bare, "{"), F.length(bare) - F.instr(F.reverse(bare), "}") + 1
        return F.when((first > 0) & (F.instr(bare, "}") > 0) & (last > first), bare.substr(first, last - first + 1))

    # bound, since each use of an expression inside a lambda is worked out anew
    return let(F.when(F.contains(text, F.lit("```")), fence).otherwise(text), span)


def review_status(support: Column, of: Column, disagreements: Column) -> Column:
    return F.when(support * 2 <= of, "minority").when(disagreements > 0, "contested").otherwise("consensus")


def label_distance(a: Column, b: Column) -> Column:
    """0 for two missing labels, 1 for one, else the edit distance by the longer one's length."""
    from .licences import stripped

    x, y = stripped(a), stripped(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(a.isNull() & b.isNull(), 0.0).when(a.isNull() | b.isNull(), 1.0).when(longest == 0, 0.0).otherwise(F.levenshtein(x, y) / longest)


def words(c: Column) -> Column:
    """The words of a text between spaces."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def word_edits(a: Column, b: Column) -> Column:
    """Edit distance of two texts in words: words become characters of a code of the pair's own, so that the built-in
    distance counts words. Null for a null."""
    past = lambda k: F.when(k >= 0xD800, k + 0x800).otherwise(k)  # noqa: E731  no character has a code from D800 to DFFF
    letter = lambda k: F.decode(F.unhex(F.lpad(F.hex(past(k).cast("long")), 8, "0")), "UTF-32")

    def coded(pair: Column) -> Column:
        code = F.array_distinct(F.concat(pair["a"], pair["b"]))
        text = lambda side, code: F.array_join(F.transform(side, lambda w: letter(F.array_position(code, w) + 0x4E00)), "")
        return F.get(F.transform(F.array(code), lambda code: F.levenshtein(text(pair["a"], code), text(pair["b"], code))), F.lit(0))

    pair = F.struct(words(a).alias("a"), words(b).alias("b"))
    return F.get(F.transform(F.array(pair), coded), F.lit(0))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point to a segment."""
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.nullif(n, F.lit(0.0)))))
    return F.sqrt(F.pow(px - (ax + t * dx), 2) + F.pow(py - (ay + t * dy), 2))


def point_distance(ax: Column, ay: Column, bx: Column, by: Column, diagonal: Column, scale: float = 0.05) -> Column:
    """Distance of two anchors, 1 from scale times the image's diagonal on, and 1 if one is missing."""
    d = F.sqrt(F.pow(ax - bx, 2) + F.pow(ay - by, 2)) / (scale * diagonal)
    return F.coalesce(F.least(F.lit(1.0), d), F.lit(1.0))


def pair_cost(label: Column, kind_differs: Column, geometry: Column, anchored: Column, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> Column:
    """Cost of a match; 1e6 where both have an anchor and are too far apart."""
    w = weights
    return F.when(anchored & (geometry >= 1.0), 1e6).otherwise(w[0] * label + w[1] * kind_differs.cast("double") + w[2] * geometry)


def polyline_samples(points: Column, n: int = 16) -> Column:
    """n points evenly spaced by length of a polyline (array of x, y); one point or no length: the first, repeated."""
    step = lambda i: F.sqrt(F.pow(F.get(points, i + 1)["x"] - F.get(points, i)["x"], 2) + F.pow(F.get(points, i + 1)["y"] - F.get(points, i)["y"], 2))
    lengths = F.when(F.size(points) > 1, F.transform(F.sequence(F.lit(0), F.size(points) - 2), step)).otherwise(F.array().cast("array<double>"))
    upto = F.aggregate(lengths, F.array(F.lit(0.0)), lambda acc, d: F.array_append(acc, F.element_at(acc, -1) + d))

    def all_(ends: Column) -> Column:
        total = F.element_at(ends, -1)

        def at(k: Column) -> Column:
            want = total * k / (n - 1)
            last = F.greatest(F.lit(0), F.least(F.size(ends) - 2, F.size(F.filter(ends, lambda e: e <= want)) - 1))

            def on(j: Column) -> Column:
                span = F.get(ends, j + 1) - F.get(ends, j)
                t = F.when(span > 0, (want - F.get(ends, j)) / span).otherwise(0.0)
                along = lambda c: F.get(points, j)[c] + t * (F.get(points, j + 1)[c] - F.get(points, j)[c])
                return F.struct(along("x").alias("x"), along("y").alias("y"))

            return F.get(F.transform(F.array(last), on), F.lit(0))

        return F.when(total > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)).otherwise(F.array_repeat(F.get(points, F.lit(0)), n))

    return F.get(F.transform(F.array(upto), all_), F.lit(0))
