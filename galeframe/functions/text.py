"""Names, file names and percent strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII spelling of German letters.
UMLAUTS = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "Ä": "Ae", "Ö": "Oe", "Ü": "Ue"}


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ascii_key(name: Column | str) -> Column:
    """Umlaut-free form of a name, used as the join key of park files."""
    out = _c(name)
    for letter, spelled in UMLAUTS.items():
        out = F.replace(out, F.lit(letter), F.lit(spelled))
    return out


def station_id(number: Column | str) -> Column:
    return F.lpad(_c(number).cast("string"), 5, "0")


def id_from_file_name(path: Column | str) -> Column:
    """Digits of a file name, zero padded: ``.../station_183.parquet`` gives ``00183``."""
    digits = F.regexp_extract(_c(path), r"(\d+)[^/\d]*\.[a-z]+$", 1)
    return F.when(digits != "", F.lpad(digits, 5, "0"))


def grid_from_file_name(path: Column | str, kind: str = "ML", lon_first: bool = False) -> tuple[Column, Column]:
    """(latitude, longitude) from ``{lat}_{lon}_ML.parquet`` or the longitude-first form."""
    pattern = rf"(-?\d+(?:[.]\d+)?)_(-?\d+(?:[.]\d+)?)_{kind}[.][a-z]+$"
    lat, lon = (2, 1) if lon_first else (1, 2)
    return tuple(F.regexp_extract(_c(path), pattern, i).cast("double") for i in (lat, lon))


def study_name_parts(name: Column | str) -> dict[str, Column]:
    """Model, output length and frequency coded in a study name."""
    return {
        "model": F.regexp_extract(_c(name), "m-([^_]+)", 1),
        "output_dim": F.regexp_extract(_c(name), "out-([0-9]+)", 1).try_cast("int"),
        "freq": F.regexp_extract(_c(name), "freq-([^_]+)", 1),
    }


def percent_to_number(value: Column | str) -> Column:
    return F.replace(_c(value), F.lit("%"), F.lit("")).try_cast("double") / 100.0


def steps_per_hour(freq: str) -> float:
    """Rows per hour of a frequency such as ``15min``, ``10min`` or ``1h``."""
    minutes = {"h": 60, "min": 1}
    unit = "min" if freq.endswith("min") else "h"
    return 60 / (int(freq[: -len(unit)] or 1) * minutes[unit])


def rescale_hours(lookback: int, horizon: int, freq: str) -> tuple[int, int]:
    """Lookback and horizon in rows instead of hours."""
    factor = steps_per_hour(freq)
    return int(lookback * factor), int(horizon * factor)
