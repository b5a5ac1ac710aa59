"""The scope of a request: include and exclude lists over games, platforms, players and areas."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lists up to this length become literals in the plan, longer ones joins with the same result.
INLINE = 500


#: Ids of a kind: a few, or a table of them (`id`).
Ids = tuple[str, ...] | DataFrame


@dataclass(frozen=True)
class Scope:
    inc_games: Ids = ()
    exc_games: Ids = ()
    inc_platforms: Ids = ()
    exc_platforms: Ids = ()
    inc_players: Ids = ()
    exc_players: Ids = ()
    inc_areas: Ids = ()
    exc_areas: Ids = ()
    all_scope: bool = True
    all_players: bool = True
    all_locations: bool = True
    single_player: bool = False

    @property
    def precomputed(self) -> bool:
        """Whether player ranks over everything answer a ranking request."""
        return self.all_scope and not self.exc_games and not self.exc_platforms


def _short(ids: Ids) -> bool:
    return not isinstance(ids, DataFrame) and len(ids) <= INLINE


def _members(df: DataFrame, column: str, ids: Ids, keep: bool) -> DataFrame:
    """Rows whose `column` is (or isn't) one of `ids`; null is never one of them, and stays when excluding."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col("id").alias(column)), column, "left_semi" if keep else "left_anti")
    if len(ids) <= INLINE:
        inside = F.col(column).isin(list(ids)) if ids else F.lit(False)
        return df.where(inside if keep else F.coalesce(~inside, F.lit(True)))
    listed = df.sparkSession.createDataFrame([(x,) for x in ids], f"{column} string")
    return df.join(listed, column, "left_semi" if keep else "left_anti")


def of_players(df: DataFrame, players: DataFrame, scope: Scope) -> DataFrame:
    """The player and location parts of the scope, for any table with player_id."""
    if not scope.all_players:
        df = _members(df, "player_id", scope.inc_players, True)
    if scope.exc_players:
        df = _members(df, "player_id", scope.exc_players, False)
    there = players.select(F.col("id").alias("player_id"), "area_id")
    if not scope.all_locations:
        df = df.join(_members(there, "area_id", scope.inc_areas, True).select("player_id"), "player_id", "left_semi")
    if scope.exc_areas:
        df = df.join(_members(there.where("area_id is not null"), "area_id", scope.exc_areas, True).select("player_id"), "player_id", "left_anti")
    return df


def apply_scope(runs: DataFrame, players: DataFrame, scope: Scope) -> DataFrame:
    """(games or platforms included) minus those excluded, for the players and locations asked for."""
    columns = runs.columns
    if not scope.all_scope:
        if _short(scope.inc_games) and _short(scope.inc_platforms):
            either: list[Column] = [F.col(c).isin(list(ids)) for c, ids in (("game_id", scope.inc_games), ("platform_id", scope.inc_platforms)) if ids]
            runs = runs.where(reduce(lambda a, b: a | b, either, F.lit(False)))
        else:
            by_game = _members(runs, "game_id", scope.inc_games, True)
            rest = _members(_members(runs, "game_id", scope.inc_games, False), "platform_id", scope.inc_platforms, True)
            runs = by_game.unionByName(rest)
    for column, ids in (("game_id", scope.exc_games), ("platform_id", scope.exc_platforms)):
        if ids:
            runs = _members(runs, column, ids, False)
    return of_players(runs, players, scope).select(columns)
