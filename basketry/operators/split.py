"""Samples and train/test splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.hashing import hash_bucket
from basketry.session import materialize


def in_train(user: str = "user_id", product: str = "product_id", train_share: float = 0.8) -> Column:
    return hash_bucket(user, product) < int(round(train_share * 100))


def hash_split(ratings: DataFrame, train_share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Split by a hash of user and product: same rows on every run and after a lost executor."""
    train = in_train(train_share=train_share)
    return ratings.filter(train), ratings.filter(~train)


def random_split(ratings: DataFrame, train_share: float = 0.8, seed: int = 42) -> list[DataFrame]:
    """Split by chance. Each part scans the rows again and draws by their place in a partition, so the
    rows are written first: computed twice, they might be placed differently and fall in both parts."""
    return materialize(ratings, "to-split").randomSplit([train_share, 1 - train_share], seed)


def bernoulli_sample(df: DataFrame, fraction: float = 0.1, seed: int = 42) -> DataFrame:
    return df.sample(False, fraction, seed)


def hash_sample(df: DataFrame, *cols: str, percent: int = 10) -> DataFrame:
    return df.filter(hash_bucket(*cols) < percent)


def sample_users(df: DataFrame, n: int = 100, user: str = "user_id", seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows (or all, if fewer), chosen by hash; a top-n, not a global sort."""
    digest = F.md5(F.concat_ws(":", F.col(user), F.lit(seed)))
    return df.orderBy(digest, user).limit(n)
