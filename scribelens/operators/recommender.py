"""The contract all recommenders share, and adapters that fulfil it."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.ml.recommendation import ALSModel
from pyspark.sql import DataFrame

from scribelens.operators import blend as blending
from scribelens.operators.categories import category_recommend
from scribelens.operators.factors import factor_topk, recommend_factors
from scribelens.operators.topics import PRF_THRESHOLD, topic_recommend


class Recommender(Protocol):
    def recommend(self, history: DataFrame, users: DataFrame, n: int = 10) -> DataFrame:
        """Ranked (user_id, article_id, score, rank), best first, for the given users."""
        ...


def _history_of(history: DataFrame, users: DataFrame) -> DataFrame:
    return history.join(users.select("user_id").distinct(), "user_id", "left_semi")


@dataclass
class FactorRecommender:
    model: ALSModel

    def recommend(self, history: DataFrame, users: DataFrame, n: int = 10) -> DataFrame:
        return recommend_factors(self.model, users, n)


@dataclass
class FactorTables:
    """Stored factors (user_id, features) and (article_id, features)."""

    user_table: DataFrame
    item_table: DataFrame

    def recommend(self, history: DataFrame, users: DataFrame, n: int = 10) -> DataFrame:
        wanted = self.user_table.join(users.select("user_id").distinct(), "user_id", "left_semi")
        return factor_topk(wanted, self.item_table, n)


@dataclass
class TopicRecommender:
    assignments: DataFrame
    prf: int = PRF_THRESHOLD
    exclude_history: bool = True

    def recommend(self, history: DataFrame, users: DataFrame, n: int = 10) -> DataFrame:
        return topic_recommend(
            _history_of(history, users), self.assignments, n, self.prf, self.exclude_history
        )


@dataclass
class CategoryRecommender:
    members: DataFrame
    similar: DataFrame

    def recommend(self, history: DataFrame, users: DataFrame, n: int = 10) -> DataFrame:
        return category_recommend(_history_of(history, users), self.members, self.similar, n)


@dataclass
class FixedLists:
    """Precomputed lists, for instance of another system."""

    lists: DataFrame

    def recommend(self, history: DataFrame, users: DataFrame, n: int = 10) -> DataFrame:
        return _history_of(self.lists, users).where(f"rank <= {int(n)}")


@dataclass
class BlendRecommender:
    """Weighted combination; `add` can be chained."""

    parts: list[tuple[float, Recommender]] = field(default_factory=list)

    def add(self, recommender: Recommender, weight: float = blending.DEFAULT_WEIGHT) -> BlendRecommender:
        self.parts.append((weight, recommender))
        return self

    def recommend(self, history: DataFrame, users: DataFrame, n: int = 10) -> DataFrame:
        lists = {
            str(i): part.recommend(history, users, blending.DEPTH * n)
            for i, (_, part) in enumerate(self.parts)
        }
        weights = {str(i): weight for i, (weight, _) in enumerate(self.parts)}
        return blending.blend(blending.tagged(lists), n, weights)
