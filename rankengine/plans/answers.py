"""One request from its query string to its answer.

What a request names is looked up in one job of filters on names, whose rows come to the driver up to a bound; what may be
more, the games of a series and the areas below an area, stays a table that the request is joined with.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import requests, resolve
from .scope import INLINE, Scope

Tables = dict[str, DataFrame]
_LINKED = {"Player": "players", "Game": "games", "Series": "series"}


def _named(table: DataFrame, box: str, keys: list[str]) -> DataFrame:
    """(box, id, keys) of rows that one of the lower-case `keys` names."""
    columns = [F.col("id_lower"), F.col("name_lower"), F.lower("full_name")] if box == "locations" else [F.col("name_lower"), F.col("slug_lower")]
    hit = reduce(lambda a, b: a | b, [c.isin(keys) for c in columns])
    return table.where(hit).select(F.lit(box).alias("box"), "id", F.array(*columns).alias("keys"))


def _below(areas: DataFrame, roots: list[str]) -> DataFrame:
    """The areas themselves, known or not, and all below them."""
    under = [F.col("id").startswith(f"{r}/") for r in roots]
    own = areas.sparkSession.createDataFrame([(r,) for r in roots], "id string")
    return areas.where(reduce(lambda a, b: a | b, under)).select("id").unionByName(own)


def scope_of(query: str, tables: Tables, lands: DataFrame) -> tuple[str, int, Scope, list[str]]:
    """Request type, limit, scope and warnings of a query string."""
    terms, kind, limit, warnings = resolve.parse_query(query)
    known = lands.collect() if any(b == "locations" for b, *_ in terms) else []  # a row for each country
    places = {key: r["code"] for r in known for key in (r["code"].lower(), r["continent"].lower())}
    asked: dict[str, list[str]] = {}
    for box, _, term in terms:
        if not (box == "locations" and term.lower() in places):
            asked.setdefault(box, []).append(term.lower())
    found = {b: _named(tables["areas" if b == "locations" else b], b, sorted(set(keys))) for b, keys in asked.items()}
    rows = reduce(DataFrame.unionByName, [df.limit(INLINE + 1) for df in found.values()]).collect() if found else []
    many = {b for b in found if sum(r["box"] == b for r in rows) > INLINE}
    ids: dict[tuple[str, str], list[str]] = {}
    tables_of: dict[tuple[str, str], list[DataFrame]] = {}
    unmatched = []
    for box, sign, term in terms:
        key = term.lower()
        if box == "locations" and key in places:
            hits = [r["area_id"] for r in known if r["code"] == places[key]]
        elif box in many:
            whole = _named(tables["areas" if box == "locations" else box], box, [key]).select("id")
            tables_of.setdefault((box, sign), []).append(whole)
            hits = [r["id"] for r in whole.limit(1).collect()]
        else:
            hits = [r["id"] for r in rows if r["box"] == box and key in r["keys"]]
        ids.setdefault((box, sign), []).extend(hits)
        if not hits:
            unmatched.append((box, f"Nothing found in {box}: {term}"))

    def members(box: str, sign: str):
        listed = sorted(set(ids.get((box, sign), ())))
        more = tables_of.get((box, sign), [])
        return reduce(DataFrame.unionByName, [*more, tables["runs"].sparkSession.createDataFrame([(x,) for x in listed], "id string")]) if more else tuple(listed)

    def games(sign: str):
        own, series = members("games", sign), members("series", sign)
        if isinstance(series, DataFrame):
            of = tables["game_series"].join(series.select(F.col("id").alias("series_id")), "series_id", "left_semi").select(F.col("game_id").alias("id"))
        elif series:
            of = tables["game_series"].where(F.col("series_id").isin(list(series))).select(F.col("game_id").alias("id"))
        else:
            return own
        few = [r["id"] for r in of.limit(INLINE + 1).collect()]
        if len(few) <= INLINE and not isinstance(own, DataFrame):
            return tuple(sorted({*own, *few}))
        return of.unionByName(own if isinstance(own, DataFrame) else of.sparkSession.createDataFrame([(x,) for x in own], "id string"))

    def areas(sign: str):
        roots = members("locations", sign)
        if isinstance(roots, DataFrame):
            closure = resolve.area_closure(tables["areas"]).withColumnRenamed("ancestor_id", "id")
            return roots.unionByName(closure.join(roots, "id", "left_semi").select(F.col("area_id").alias("id")))
        return _below(tables["areas"], list(roots)) if roots else ()

    given = lambda *boxes: [1 for b, sign, _ in terms if b in boxes and not sign]
    parts = {f"{name}_{k}": f(sign) for name, sign in (("inc", ""), ("exc", "!")) for k, f in (("games", games), ("platforms", lambda s: members("platforms", s)), ("players", lambda s: members("players", s)), ("areas", areas))}
    scope = Scope(**parts, all_scope=not given("series", "games", "platforms"), all_players=not given("players"), all_locations=not given("locations"), single_player=len(given("players")) == 1)
    return kind, limit, scope, [*warnings, *[w for _, w in sorted(unmatched, key=lambda x: x[0])]]


def answer_query(query: str, tables: Tables, lands: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows of a query string's answer, with `truncated`, and its warnings."""
    kind, limit, scope, warnings = scope_of(query, tables, lands)
    return requests.cut(requests.answer(tables, kind, scope, limit), limit), warnings


def enrichment(rows: DataFrame, tables: Tables) -> tuple[DataFrame | None, DataFrame | None]:
    """What an answer's cells are shown with: the styles of its players, and (column, name, slug) of what has a page of its
    own. None where the answer names no player, or nothing with pages."""
    styles = requests.player_styles(rows.select(F.col("Player").alias("name")), tables["players"], tables["areas"]) if "Player" in rows.columns else None
    name = lambda c: F.col(c).alias("name")
    slugs = [requests.cell_slugs(rows.select(name(c)), tables[t]).select(F.lit(c).alias("column"), "name", "slug") for c, t in _LINKED.items() if c in rows.columns]
    return styles, reduce(DataFrame.unionByName, slugs) if slugs else None
