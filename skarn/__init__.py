"""skarn: a Spark-native relational analytics engine."""

from __future__ import annotations


def open(spark, directory: str | None = None, folder: str | None = None):  # noqa: A001
    """A session; with a directory its Parquet tables are attached, with a folder table versions are written there."""
    from skarn.session import Session

    session = Session(spark, folder)
    return session.attach(directory) if directory else session
