"""Getting answers from recognisers and pages out of PDF files: the work that leaves Spark.

A recogniser is an object with ``key`` and ``run(image) -> dict`` of the envelope's fields; any that pickles will do.
Calls cost money, so ``recognise`` results belong in ``sinks.results`` at once, speculative execution should be
off, and everything after reads the stored answers. The two REST clients need a network; PDF tools must be
on the executors' PATH.
"""

from __future__ import annotations

import datetime
import json
import subprocess
import tempfile
import time
import urllib.request
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Recogniser(Protocol):
    key: str

    def run(self, image: bytes) -> dict: ...


def _envelope(service: str, version: str, text: str, began: float, took: float, raw: bytes) -> dict:
    date = datetime.datetime.fromtimestamp(began, datetime.UTC).strftime("%Y-%m-%d %H:%M:%S UTC")
    return {"service": service, "version": version, "text": text, "milliseconds": int(took * 1000), "date": date, "raw": raw}


def _call(url: str, key: str, data: bytes | None = None, timeout: float = 15):
    headers = {"Ocp-Apim-Subscription-Key": key} | ({"Content-Type": "application/octet-stream"} if data is not None else {})
    return urllib.request.urlopen(urllib.request.Request(url, data=data, headers=headers), timeout=timeout)  # noqa: S310


# Fixed values in the clients: paths, headers and fields of the services' protocols.


@dataclass(frozen=True)
class AzureText:
    """One call; the answer comes with it."""

    endpoint: str
    subscription_key: str
    key: str = "azu"
    version: str = "vision/v3.1/ocr"

    def run(self, image: bytes) -> dict:
        began = time.time()
        with _call(f"{self.endpoint}{self.version}?language=unk&detectOrientation=false", self.subscription_key, image) as answer:
            took, status, raw = time.time() - began, answer.status, answer.read()
        found = json.loads(raw)
        if status != 200 or found.get("code"):
            raise RuntimeError(f"{self.key}: status {status} {found.get('code', '')} {found.get('message', '')}")
        lines = [" ".join(w["text"] for w in line["words"]) for region in found.get("regions") or [] for line in region["lines"]]
        return _envelope("Azure", self.version, "\n".join(lines), began, took, raw)


@dataclass(frozen=True)
class AzureReading:
    """The call names a place that is asked until the answer is there."""

    endpoint: str
    subscription_key: str
    key: str = "azuR"
    version: str = "vision/v3.1/read/analyze"
    tries: int = 15
    wait: float = 1.0

    def run(self, image: bytes) -> dict:
        began = time.time()
        with _call(f"{self.endpoint}{self.version}", self.subscription_key, image) as answer:
            place = answer.headers.get("Operation-Location")
            if answer.status != 202 or not place:
                raise RuntimeError(f"{self.key}: status {answer.status}, no place for the answer")
        found: dict = {}
        for _ in range(self.tries):
            time.sleep(self.wait)
            with _call(place, self.subscription_key) as answer:
                raw, took = answer.read(), time.time() - began
            found = json.loads(raw)
            if (found.get("error") or {}).get("code") or found.get("status") == "failed":
                raise RuntimeError(f"{self.key}: {found.get('error', 'failed')}")
            if found.get("status") == "succeeded":
                done = found["analyzeResult"]
                lines = [line["text"] for page in done["readResults"] for line in page["lines"]]
                return _envelope("AzureRead", done["version"], "\n".join(lines), began, took, raw)
        raise RuntimeError(f"{self.key}: no answer after {self.tries} tries, last {found.get('status')}")


@dataclass(frozen=True)
class AwsText:
    """Needs boto3; credentials come from its own configuration."""

    region: str
    key: str = "aws"

    def run(self, image: bytes) -> dict:
        import boto3
        from botocore.config import Config

        client = boto3.client("textract", self.region, config=Config(retries={"max_attempts": 3}))
        began = time.time()
        found = client.detect_document_text(Document={"Bytes": image})
        took = time.time() - began
        blocks = {"Blocks": found["Blocks"]}
        text = "\n".join(b["Text"] for b in found["Blocks"] if b["BlockType"] == "LINE")
        return _envelope("AWS", found["DetectDocumentTextModelVersion"], text, began, took, json.dumps(blocks).encode())


@dataclass(frozen=True)
class GcpText:
    """Needs google-cloud-vision; a page without text gives an empty answer."""

    credentials: str
    key: str = "gcp"

    def run(self, image: bytes) -> dict:
        from google.cloud import vision

        client = vision.ImageAnnotatorClient.from_service_account_file(self.credentials)
        began = time.time()
        found = client.document_text_detection(image=vision.Image(content=image)).full_text_annotation
        took = time.time() - began
        raw = json.dumps(type(found).to_dict(found, preserving_proto_field_name=True)).encode() if found else b"{}"
        return _envelope("GCP", "v1", found.text if found else "", began, took, raw)


ANSWER = "ptr string, provider string, service string, version string, text string, milliseconds bigint, date string, raw binary, error string"


def recognise(pages: DataFrame, recognisers: list[Recogniser], ptr: str = "ptr", image: str = "content") -> DataFrame:
    """One row for each page and recogniser; a failed call is a row with ``error`` and without an answer."""
    names = [r.key for r in recognisers]
    each = pages.select(F.col(ptr).alias("ptr"), F.col(image).alias("content"), F.explode(F.lit(names)).alias("provider")).repartition(F.col("ptr"), F.col("provider"))
    by_key = {r.key: r for r in recognisers}
    fields = "service", "version", "text", "milliseconds", "date", "raw"

    def make(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for p, content, provider in batch[["ptr", "content", "provider"]].itertuples(index=False):
                try:
                    got, error = by_key[provider].run(bytes(content)), None
                except Exception as e:  # a page that a service refuses drops out of the comparison
                    got, error = dict.fromkeys(fields), str(e)
                rows.append([p, provider, *(got[f] for f in fields), error])
            out = pd.DataFrame(rows, columns=["ptr", "provider", *fields, "error"])
            yield out.astype({"milliseconds": "Int64"})

    return each.mapInPandas(make, ANSWER)


def _ran(*command: str) -> str:
    return subprocess.run(command, check=True, capture_output=True, text=True).stdout


def pdf_pages(files: DataFrame, dpi: int = 300, gs: str = "gs", magick: str = "magick") -> DataFrame:
    """(ptr, page, text, content): each page's text layer and its picture as PNG, of files (path, content).

    Fixed values: the tools' command lines.
    """

    def pages(name: str, content: bytes):
        with tempfile.TemporaryDirectory() as d:
            pdf = Path(d, "in.pdf")
            pdf.write_bytes(content)
            n = int(_ran(gs, "-q", "-dNODISPLAY", f"--permit-file-read={pdf}", "-c", f"({pdf}) (r) file runpdfbegin pdfpagecount = quit"))
            width = len(str(n - 1))
            for i in range(n):
                text = _ran(gs, "-q", "-dBATCH", "-dNOPAUSE", "-sDEVICE=txtwrite", f"-dFirstPage={i + 1}", f"-dLastPage={i + 1}", "-sOutputFile=-", str(pdf))
                png = Path(d, f"{i}.png")
                _ran(magick, "-density", str(dpi), f"{pdf}[{i}]", "-quality", "00", str(png))
                yield f"{name}-{i:0{width}d}", i, text, png.read_bytes()

    def make(batches):
        import pandas as pd

        for batch in batches:
            for path, content in batch[["path", "content"]].itertuples(index=False):
                for row in pages(Path(path).stem, bytes(content)):
                    yield pd.DataFrame([row], columns=["ptr", "page", "text", "content"])

    return files.select("path", "content").mapInPandas(make, "ptr string, page int, text string, content binary")


def credentials(path: str) -> dict:
    """A client's endpoint and key from a JSON file (fixed values: the fields' names); both must be there."""
    found = json.loads(Path(path).read_text())
    empty = [field for field in ("endpoint", "subscription_key") if not found.get(field)]
    if empty:
        raise ValueError(f"{path} has no value for {' and '.join(empty)}")
    return {"endpoint": found["endpoint"], "subscription_key": found["subscription_key"]}


def cost(pages: int, providers: int, per_call: float = 0.0015) -> float:
    """What recognising costs, in dollars (the price of one call is a fixed value)."""
    return pages * providers * per_call


__all__ = ["AwsText", "AzureReading", "AzureText", "GcpText", "Recogniser", "cost", "credentials", "pdf_pages", "recognise"]
