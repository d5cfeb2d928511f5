"""What a typed name means among the values a list can be filtered by."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: values that a message names.
SHOWN = 8
_ID = re.compile(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I)


class OptionError(ValueError):
    """A name that means no value, or several."""


def resolve(options: DataFrame, flag: str, typed: str) -> str:
    """The value that ``typed`` means among ``options`` (value, names: an array, the first of which is shown).

    An id is taken as it is.  Else a name that is equal but for case, and only if there is none, such as contain it.
    Raises :class:`OptionError` where several values fit, or none: it then names those that begin most alike.
    """
    if _ID.fullmatch(typed):
        return typed
    wanted = typed.strip().lower()
    low = options.withColumn("_low", F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda n: F.lower(n)))
    label = F.coalesce(F.try_element_at("names", F.lit(1)), F.col("value").cast("string"))
    for fits in (F.array_contains("_low", wanted), F.exists("_low", lambda n: F.contains(n, F.lit(wanted)))):
        found = low.where(fits).select("value", label.alias("label")).orderBy("label", "value").limit(SHOWN + 1).collect()
        if len(found) == 1:
            return found[0]["value"]
        if found:
            names = ", ".join(r["label"] for r in found[:SHOWN]) + (" and more" if len(found) > SHOWN else "")
            raise OptionError(f"{flag} {typed} matches more than one: {names}. Use a more exact name.")
    steps = F.sequence(F.lit(1), F.lit(max(1, len(wanted))))
    shared = F.array_max(F.transform("_low", lambda n: F.size(F.filter(steps, lambda i: F.left(n, i) == F.left(F.lit(wanted), i)))))
    near = low.select(label.alias("label"), F.coalesce(shared, F.lit(0)).alias("shared")).orderBy(F.col("shared").desc(), "label").limit(SHOWN)
    names, more = [r["label"] for r in near.collect()], options.count() - SHOWN
    raise OptionError(f"{flag} {typed} matched nothing. Known values: {', '.join(names)}" + (f" and {more} more." if more > 0 else "."))
