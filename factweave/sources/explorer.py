"""Block-explorer addresses: what a URL names, which API call answers it, and the source inside the answer.

Fetching is left to a function the caller gives, so nothing here needs a network.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from urllib.parse import urlencode, urlparse

from pyspark.sql import DataFrame, SparkSession

from .scan import as_sources

# Explorers and the API behind each.
PLATFORMS = {"etherscan.io": "https://api.etherscan.io/api", "polygonscan.com": "https://api.polygonscan.com/api", "bscscan.com": "https://api.bscscan.com/api", "arbiscan.io": "https://api.arbiscan.io/api"}


def parse_url(url: str) -> tuple[str, str, str]:
    """(platform, ``tx`` or ``address``, value)."""
    found = urlparse(url if "//" in url else f"https://{url}")
    host = found.netloc.removeprefix("www.")
    m = re.fullmatch(r"/(tx|address)/(0x[0-9a-fA-F]+)", found.path.rstrip("/"))
    if host not in PLATFORMS or not m or len(m[2]) != (66 if m[1] == "tx" else 42):
        raise ValueError(f"not an explorer address: {url}")
    return host, m[1], m[2].lower()


def api_url(platform: str, module: str, action: str, key: str | None = None, **values: str) -> str:
    return f"{PLATFORMS[platform]}?{urlencode({'module': module, 'action': action, **values, **({'apikey': key} if key else {})})}"


def sources_in(answer: str) -> dict[str, str]:
    """Path to content of a source answer: one file, or several in a JSON object."""
    first = json.loads(answer)["result"][0]
    text = first["SourceCode"]
    if text.startswith("{"):
        inner = json.loads(text[1:-1] if text.startswith("{{") else text)
        return {path: f["content"] for path, f in inner.get("sources", inner).items()}
    return {f"{first.get('ContractName') or 'Contract'}.sol": text} if text else {}


def fetch(spark: SparkSession, url: str, get: Callable[[str], str], key: str | None = None) -> DataFrame:
    """The sources of the contract a URL names; a transaction is followed to its receiver."""
    platform, kind, value = parse_url(url)
    if kind == "tx":
        value = json.loads(get(api_url(platform, "proxy", "eth_getTransactionByHash", key, txhash=value)))["result"]["to"]
    found = sources_in(get(api_url(platform, "contract", "getsourcecode", key, address=value)))
    return as_sources(spark.createDataFrame(list(found.items()), "path string, content string"))
