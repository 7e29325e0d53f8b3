"""Image quality on pixel planes held as flat arrays of grey levels."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def grey(r: Column, g: Column, b: Column) -> Column:
    """Grey plane of three colour planes, by the usual luma weights."""
    both = F.zip_with(r, g, lambda x, y: x * 0.299 + y * 0.587)
    return F.zip_with(both, b, lambda s, z: s + z * 0.114)


def mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def laplacian_variance(plane: Column, width: int, height: int) -> Column:
    """Population variance of the 4-neighbour Laplacian, borders mirrored without repeating the edge."""
    # bound once as a lambda's variable; inlined, the plane would be computed anew for every cell
    return F.get(F.transform(F.array(plane), lambda p: _laplacian_variance(p, width, height)), F.lit(0))


def _laplacian_variance(plane: Column, width: int, height: int) -> Column:
    def at(i, dr, dc):
        row, col = F.floor(i / width), i % width
        r, c = row + dr, col + dc
        r = F.when(r < 0, -r).when(r >= height, F.lit(2 * height - 2) - r).otherwise(r)
        c = F.when(c < 0, -c).when(c >= width, F.lit(2 * width - 2) - c).otherwise(c)
        return F.get(plane, (r * width + c).cast("int"))

    cells = F.sequence(F.lit(0), F.lit(width * height - 1))
    lap = F.transform(cells, lambda i: (at(i, -1, 0) + at(i, 1, 0) + at(i, 0, -1) + at(i, 0, 1) - F.get(plane, i) * 4).cast("double"))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    n = width * height
    return F.aggregate(lap, zero, lambda a, x: F.struct((a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")), lambda a: a["q"] / n - (a["s"] / n) * (a["s"] / n))


def colour_spread(r: Column, g: Column, b: Column) -> Column:
    """Largest difference of the channels' means; small for grey images."""
    return F.greatest(F.abs(mean(r) - mean(g)), F.abs(mean(g) - mean(b)), F.abs(mean(r) - mean(b)))


def reasons(blur: Column, spread: Column, brightness: Column, confidence: Column, side: Column, *, min_blur: float, min_spread: float = 5.0, dark: float = 30.0, bright: float = 225.0, min_confidence: float = 0.7, min_side: int = 50) -> Column:
    """All reasons against an image, in the order blur, grey, exposure, confidence, size; NULL measures give none."""
    checks = [
        F.when(blur < min_blur, "blurred"),
        F.when(spread < min_spread, "grey"),
        F.when(brightness < dark, "too dark").when(brightness > bright, "too bright"),
        F.when(confidence < min_confidence, "low confidence"),
        F.when(side < min_side, "small face"),
    ]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def described(blur: Column, spread: Column, brightness: Column, confidence: Column, side: Column, *, min_blur: float, min_spread: float = 5.0, dark: float = 30.0, bright: float = 225.0, min_confidence: float = 0.7, min_side: int = 50) -> Column:
    """The reasons of :func:`reasons` with the figures they rest on."""
    checks = [
        F.when(blur < min_blur, F.format_string(f"Blurry (laplacian=%.1f, threshold={min_blur})", blur)),
        F.when(spread < min_spread, F.format_string("Grayscale/IR (channel diff=%.1f)", spread)),
        F.when(brightness < dark, F.format_string(f"Underexposed (brightness=%.1f, min={dark})", brightness)).when(brightness > bright, F.format_string(f"Overexposed (brightness=%.1f, max={bright})", brightness)),
        F.when(confidence < min_confidence, F.format_string(f"Low confidence (%.2f, min={min_confidence})", confidence)),
        F.when(side < min_side, F.format_string(f"Face too small (%dx%d, min={min_side}px)", side.cast("int"), side.cast("int"))),
    ]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())
