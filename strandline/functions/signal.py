"""Functions of audio blocks: arrays of samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def rms(samples: Column) -> Column:
    total = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(total / F.size(samples))).otherwise(0.0)


def peak(samples: Column) -> Column:
    return F.aggregate(samples, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double"))))


def has_voice(samples: Column, threshold: float = C.VOICE_RMS) -> Column:
    """Strictly louder than the threshold; an empty block has no voice."""
    return rms(samples) > threshold


def auto_gain(samples: Column, target: float = 0.7, quiet: float = 0.005, most: float = 20.0, least: float = 1.2) -> Column:
    """Amplified to the target peak unless near silent or loud enough, clipped to 1."""
    p = peak(samples)
    gain = F.least(F.lit(target) / F.greatest(p, F.lit(1e-12)), F.lit(most))
    # The gain comes from all samples, so it stands outside the lambda, which runs for each.
    gains = F.array_repeat(gain, F.size(samples))
    loud = F.zip_with(samples, gains, lambda x, g: F.least(F.lit(1.0), F.greatest(F.lit(-1.0), x.cast("double") * g)))
    plain = F.transform(samples, lambda x: x.cast("double"))
    return F.when((p >= quiet) & (gain > least), loud).otherwise(plain)


def tail_slice(samples: Column, n: int) -> Column:
    """The last n samples; all of them if n is not positive or too many."""
    if n <= 0:
        return samples
    return F.when(F.size(samples) > n, F.slice(samples, -n, n)).otherwise(samples)
