"""The rerank score and its parts, as columns and windows over each query's pool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The most that each part of the score may add or take.
PERSON, LOCATION, ACTION, GENERIC, STATEMENT, FRAGMENT = 0.08, 0.06, 0.12, 0.02, 0.04, 0.06
BOTH_CHANNELS, NAVIGATION, IDENTITY = 0.02, 0.32, 0.20
VECTOR, VECTOR_FLOOR, VECTOR_WIDTH = 0.32, 0.75, 0.03


def supports(tokens: Column, person: Column, locations: Column, actions: Column, expanded: Column, generic: Column, first_names: Column) -> dict[str, Column]:
    """Role supports of a passage's tokens. person: the name's terms in order, the last one the surname.

    A whole name outranks a surname; another first name beside the surname is someone else. Expanded
    actions count only beside a person or a place."""
    common = F.array_intersect(person, tokens)
    surname, given = F.try_element_at(person, F.lit(-1)), F.slice(person, 1, F.greatest(F.size(person) - 1, F.lit(0)))
    stranger = (F.size(given) > 0) & ~F.arrays_overlap(given, tokens) & (F.size(F.array_except(F.array_intersect(tokens, first_names), person)) > 0)
    p = F.when((F.size(person) == 0) | (F.size(common) == 0), 0.0).when(F.size(common) == F.size(F.array_distinct(person)), PERSON).when(F.array_contains(tokens, surname) & stranger & (F.size(person) > 1), 0.0).otherwise(PERSON / 2)
    place = F.when(F.arrays_overlap(locations, tokens), LOCATION).otherwise(0.0)
    near = (p > 0) | (place > 0)
    acts = F.arrays_overlap(actions, tokens) | (near & F.arrays_overlap(expanded, tokens))
    return {"person": p, "location": place, "action": F.when(acts & near, ACTION).when(acts, GENERIC).otherwise(0.0), "generic": F.least(F.lit(GENERIC), F.size(F.array_intersect(generic, tokens)) * 0.01)}


def vector_bonus(distance: Column) -> Column:
    """A smooth step on the similarity 1 / (1 + distance)."""
    s = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (1 / (1 + distance) - VECTOR_FLOOR) / VECTOR_WIDTH))
    return F.when(distance >= 0, VECTOR * s * s * (3 - 2 * s)).otherwise(0.0)


def rerank(rows: DataFrame, by: str, id: str, pool: bool = True) -> DataFrame:
    """rows with the parts of the score, final_score and rank within each query.

    rows: person, location, action, generic, fragment (supports), n_tokens, semantic and lexical (flags),
    vector_rank, distance, lexical_score, navigation, competing, whole_name (flags) and coverage (of the query).
    pool: lexical strength relative to the pool's median and ranks, else absolute."""
    c = F.col
    semantic, lexical = c("semantic"), c("lexical")
    every = Window.partitionBy(by)
    percent = lambda rank, n: F.when(n > 0, (n - rank + 1) / n).otherwise(0.0)
    n_sem, n_lex = F.count_if(semantic).over(every), F.count_if(lexical).over(every)
    score = F.coalesce(c("lexical_score"), F.lit(0.0))
    sem_rank = F.row_number().over(every.orderBy(F.when(semantic, 0).otherwise(1), "vector_rank", id))
    lex_rank = F.rank().over(every.orderBy(F.when(lexical, 0).otherwise(1), F.desc(score)))
    ranked = rows.withColumns({"parent_prior": F.when(semantic, percent(sem_rank, n_sem)).otherwise(0.0), "lexical_rank": F.when(lexical, lex_rank), "__n": n_lex, "__median": F.median(F.when(lexical, score)).over(every)})
    middle = c("__median")
    rank_part = F.when(lexical, percent(c("lexical_rank"), c("__n"))).otherwise(0.0) if pool else F.lit(0.0)
    score_part = F.when((score > 0) & (middle > 0), score / (score + middle)).otherwise(0.0) if pool else F.when(score > 0, score / (score + 1)).otherwise(0.0)
    statement = F.when((c("action") >= ACTION) & (c("n_tokens") >= 20), STATEMENT).otherwise(0.0)
    local = F.least(F.lit(1.0), c("person") / PERSON * 0.4 + c("action") / ACTION * 0.4 + c("location") / LOCATION * 0.1 + statement / STATEMENT * 0.1 + c("fragment") / FRAGMENT * 0.2)
    words = F.when(lexical, (0.6 * score_part + 0.4 * rank_part) * (0.35 + 0.65 * (c("person") / PERSON + c("location") / LOCATION) / 2)).otherwise(0.0)
    near = F.when(semantic, local).otherwise(0.0)
    promoted = F.when((c("fragment") > 0) & (((near == 0) & (words > 0)) | (c("fragment") < FRAGMENT)), c("fragment")).otherwise(0.0)
    passage = F.least(F.lit(1.0), F.greatest(near, words) + promoted)
    heuristic = passage + F.when(semantic & lexical, BOTH_CHANNELS).otherwise(0.0) + c("location") + c("action") + c("generic") + statement
    covered = F.when((c("person") > 0) & (c("action") >= ACTION), 1.0).otherwise(c("coverage"))
    scale = F.when((c("person") > 0) & (c("person") < PERSON), c("person") / PERSON).otherwise(1.0)
    vector = F.when(semantic & ~c("navigation"), vector_bonus(c("distance")) * scale).otherwise(0.0)
    supported = heuristic * covered + F.coalesce(vector, F.lit(0.0)) + F.when(c("whole_name") & (c("person") >= PERSON) & ~c("navigation"), IDENTITY).otherwise(0.0)
    penalty = F.when(c("navigation"), NAVIGATION).otherwise(0.0) + F.when(c("competing"), F.least(F.lit(VECTOR), supported / 2)).otherwise(0.0)
    rounded = {"lexical_support": words, "local_support": local, "heuristic_score": heuristic, "vector_bonus": F.coalesce(vector, F.lit(0.0)), "final_score": supported - penalty}
    out = ranked.withColumns({k: F.bround(v, 6) for k, v in rounded.items()}).drop("__n", "__median")
    order = [F.desc("final_score"), F.coalesce("vector_rank", F.lit(999_999)), id]
    return out.withColumn("rank", F.row_number().over(every.orderBy(*order)).cast("long"))


def assertion_score(text: Column, asserted: str, steering: str, turned: str, toward: str, hits: Column, fragment: Column) -> Column:
    """100 for an asserted movement, 40 each for steering and turning, 10 for up to three endpoints, and the features' own points."""
    flag = lambda p, n: F.when(text.rlike(p), n).otherwise(0)
    return flag(asserted, 100) + flag(steering, 40) + flag(turned, 40) + F.least(F.regexp_count(text, F.lit(toward)), F.lit(3)) * 10 + (fragment * 1000).cast("int") + hits
