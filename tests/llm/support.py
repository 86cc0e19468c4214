"""Texts the brute-force tests share."""

import pyarrow.parquet as pq

from .conftest import ODD  # noqa: F401

SMALL = "/root/testdata/sf0.001"


def sample_texts(n):
    return [t[:3000] for t in pq.read_table(f"{SMALL}/documents.parquet", columns=["text"])["text"].to_pylist()[:n]]
