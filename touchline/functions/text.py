"""Viewer wording: headlines, ranked facts, details, hedging check."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline import constants as C


def headline(kind: Column) -> Column:
    lookup = F.create_map(*[F.lit(v) for pair in C.HEADLINES.items() for v in pair])
    return lookup[kind]


def _whole(value: Column) -> Column:
    return F.rint(value).cast("bigint").cast("string")


def _floor(value: Column) -> Column:
    return value.cast("bigint").cast("string")


def facts(col: Callable[[str], Column] = F.col, limit: int = 3) -> Column:
    """Up to ``limit`` measured facts, most noteworthy first, ties in listed order."""
    ahead, near = col("attackers_ahead_of_ball"), col("nearest_defender_dist")
    entries, line = col("recent_box_entry_count"), col("defensive_line_x")
    space, held = col("space_ahead_of_ball"), col("possession_duration_s")
    rules = [
        ("attackers_ahead", ahead >= 2, ahead,
         F.concat(_floor(ahead), F.lit(" attackers ahead of the ball")), ahead),
        ("nearest_defender", near >= 5.0, near / 5.0,
         F.concat(F.lit("nearest defender "), _whole(near), F.lit(" m away")), near),
        ("recent_entries", entries >= 1, entries + 2.0,
         F.concat(_floor(entries), F.lit(" recent penalty-area "),
                  F.when(entries == 1, "entry").otherwise("entries")), entries),
        ("high_line", line > 5.0, line / 10.0,
         F.concat(F.lit("defensive line "), _whole(line), F.lit(" m beyond halfway")), line),
        ("space_ahead", space >= 12.0, space / 12.0,
         F.concat(_whole(space), F.lit(" m of space ahead of the ball")), space),
        ("possession", held >= 12.0, held / 12.0,
         F.concat(_whole(held), F.lit(" s of unbroken possession")), held),
    ]
    candidates = F.array(*[
        F.when(
            applies,
            F.struct(
                (-weight.cast("double")).alias("rank"), F.lit(i).alias("ordinal"),
                F.lit(key).alias("key"), text.alias("text"), value.cast("double").alias("value"),
            ),
        )
        for i, (key, applies, weight, text, value) in enumerate(rules)
    ])
    chosen = F.slice(F.array_sort(F.filter(candidates, lambda c: c.isNotNull())), 1, limit)
    return F.transform(
        chosen,
        lambda c: F.struct(c["key"].alias("key"), c["text"].alias("text"), c["value"].alias("value")),
    )


def detail(chosen: Column) -> Column:
    """Facts joined into one clause: first letter upper case, the rest lower case."""
    texts = F.transform(chosen, lambda c: c["text"])
    n = F.size(texts)
    joined = F.when(n <= 1, F.array_join(texts, "")).otherwise(
        F.concat(
            F.array_join(F.slice(texts, 1, F.greatest(n - 1, F.lit(0))), ", "),
            F.lit(" and "),
            F.get(texts, n - 1),
        )
    )
    return F.concat(F.upper(F.substr(joined, F.lit(1), F.lit(1))), F.lower(F.substr(joined, F.lit(2))))


def is_hedged(text: Column) -> Column:
    lowered = F.lower(text)
    asserts = F.exists(F.array(*map(F.lit, C.FORBIDDEN_PHRASES)), lambda t: F.contains(lowered, t))
    hedges = F.exists(F.array(*map(F.lit, C.HEDGE_TERMS)), lambda t: F.contains(lowered, t))
    return hedges & ~asserts
