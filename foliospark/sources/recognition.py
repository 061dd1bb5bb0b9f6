"""Text recognition of page images through a pluggable back end."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.operators.pages import is_scan_page

Backend = Callable[[bytes], tuple[str, float]]
RECOGNIZED = "document_id string, page_number int, text string, confidence double, error string"


def pages_to_recognize(pages: DataFrame) -> DataFrame:
    """Pages of (document_id, page_number, text, area, has_images) whose text is too thin for what they show."""
    return pages.where(is_scan_page(F.length(F.coalesce("text", F.lit(""))), F.col("area"), F.coalesce("has_images", F.lit(False))))


def recognize(pages: DataFrame, make: Callable[[], Backend], attempts: int = 3, wait: float = 1.0) -> DataFrame:
    """(document_id, page_number, text, confidence, error) of (document_id, page_number, image).

    The back end is made once in each Python worker. A page is tried again after a time-out, with doubled waits; other
    errors, and a page that keeps failing, give a row with null text and the error.
    """

    def one(backend: Backend, image: bytes) -> tuple[str | None, float | None, str | None]:
        for i in range(attempts):
            try:
                return (*backend(image), None)
            except TimeoutError as e:
                error = f"{type(e).__name__}: {e}"
                if i + 1 < attempts:
                    time.sleep(wait * 2**i)
            except Exception as e:  # one bad page must not stop the others
                return None, None, f"{type(e).__name__}: {e}"
        return None, None, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make()
        for pdf in batches:
            done = [one(backend, bytes(x)) for x in pdf["image"]]
            out = pd.DataFrame(done, columns=["text", "confidence", "error"])
            yield pd.concat([pdf[["document_id", "page_number"]].reset_index(drop=True), out.astype({"confidence": "float64"})], axis=1)

    return pages.where("image IS NOT NULL").select("document_id", "page_number", "image").mapInPandas(run, RECOGNIZED)
