"""Before a start: is there room for the indexes, and is there new mail to take in?"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.operators import logs
from siltwork.settings import Settings


def guard(needs: DataFrame, settings: Settings, ask: Callable[[str], bool] | None = None) -> str:
    """ok, tight or insufficient for needs(need, available), all in GiB together; refuses to go on with too little.

    A check that is switched off says ok. Too little room goes on if the override is set or ask() agrees, else it raises.
    """
    if not settings.preflight:
        return "ok"
    total = needs.agg(F.coalesce(F.sum("need"), F.lit(0.0)).alias("need"), F.coalesce(F.min("available"), F.lit(0.0)).alias("available"))
    need, available, verdict = total.select("need", "available", logs.assess(F.col("need"), F.col("available"))).first()
    if verdict == "insufficient" and not settings.preflight_override and not (ask and ask(f"{need:.1f} GiB needed, {available:.1f} there. Start anyway?")):
        raise RuntimeError(f"{need:.1f} GiB needed, {available:.1f} there")
    return verdict


def offer_refresh(mails: DataFrame, state: DataFrame, ask: Callable[[str], bool] | None, refresh: Callable[[], None]) -> str:
    """Count the mails above their folders' marks, say what taking them in costs, and refresh if ask() agrees.

    Nothing here ends a start: without anyone to ask nothing happens, and a refresh that fails is told. A folder whose
    validity has changed can't be counted and is told as such.
    """
    if ask is None:
        return "nobody to ask"
    per = logs.count_new(mails, state)
    told = per.agg(F.sum("new").alias("n"), F.count_if(F.col("new").isNull()).alias("changed"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("new") > 0, F.concat_ws(": ", "folder", "new")))), ", ").alias("where"))
    n, changed, where, cost = told.select("n", "changed", "where", logs.cost(F.coalesce("n", F.lit(0)))[1]).first()
    if not n and not changed:
        return "no new mail"
    said = f"{n or 0} new ({where or '-'})" + (f", {changed} folders start anew" if changed else "")
    if not ask(f"{said}: take in, {cost}?"):
        return f"{said}: left"
    try:
        refresh()
    except Exception as error:  # an index that is a little old is better than no start
        return f"{said}: failed ({type(error).__name__}: {error})"
    return f"{said}: taken in"
