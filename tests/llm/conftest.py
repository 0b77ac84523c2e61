from __future__ import annotations

import re

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, or from (text, source) pairs."""

    def make(texts, first=0):
        rows = []
        for i, t in enumerate(texts):
            text, source = t if isinstance(t, tuple) else (t, "src0")
            rows.append((first + i, text, "en", source, len(text or "")))
        return spark.createDataFrame(rows, COLUMNS)

    return make
