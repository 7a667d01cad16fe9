"""Recovery of structured rows from model output, and greedy selection."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

_THINK = re.compile(r"<think>.*?(</think>|$)", re.S)
_TRAILING = re.compile(r",\s*(?=[}\]])")
_FIELD = re.compile(r"[\"'](\w+)[\"']\s*:\s*[\"']([^\"']*)[\"']")
_CLOSE = {"{": "}", "[": "]"}


def blocks(text: str | None) -> list[str]:
    """Outermost balanced {...} and [...] stretches outside of think tags; strings are skipped over, an open end is taken as it is."""
    clean, out, at = _THINK.sub("", text or ""), [], 0
    while at < len(clean):
        if clean[at] not in _CLOSE:
            at += 1
            continue
        stack, i, quote = [], at, ""
        while i < len(clean):
            c = clean[i]
            if quote:
                i += c == "\\"
                quote = "" if c == quote else quote
            elif c == '"':
                quote = c
            elif c in _CLOSE:
                stack.append(_CLOSE[c])
            elif stack and c == stack[-1]:
                stack.pop()
                if not stack:
                    break
            i += 1
        out.append(clean[at : i + 1])
        at = i + 1
    return out


def parse(block: str) -> Any:  # noqa: ANN401
    """JSON, then JSON without trailing commas, then a Python literal, then whatever fields are whole; None without any."""
    for attempt in (block, _TRAILING.sub("", block)):
        try:
            return json.loads(attempt)
        except ValueError:
            pass
    try:
        return ast.literal_eval(_TRAILING.sub("", block))
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        fields = dict(_FIELD.findall(block))
        return fields or None


def rows_of(payload: Any) -> list[dict]:  # noqa: ANN401
    """A list, the list under 'triples', or a single object, as rows."""
    if isinstance(payload, dict):
        inner = payload.get("triples")
        return rows_of(inner) if isinstance(inner, list) else [payload]
    return [r for r in payload if isinstance(r, dict)] if isinstance(payload, list) else []


def recover(df: DataFrame, key: str, text: str, fields: list[str]) -> DataFrame:
    """(key, seq, fields...) of every object in every block of each text; texts without any give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b[key].tolist(), b[text], strict=True):
                found = [r for x in blocks(t) for r in rows_of(parse(x))]
                out += [(k, i, *(None if r.get(f) is None else str(r[f]) for f in fields)) for i, r in enumerate(found)]
            yield pd.DataFrame(out, columns=[key, "seq", *fields])

    return df.select(key, text).mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, seq int, " + ", ".join(f"`{f}` string" for f in fields))


def mmr(pool: DataFrame, k: int = 5, *, qkey: str = "qid", key: str = "doc_id", alike: float = 0.22, same: float = 0.03) -> DataFrame:
    """Greedy choice from (qid, doc_id, score, tokens, source): score less ``alike`` times the largest token
    similarity to what is chosen, less ``same`` for each chosen row of the same source. Scores are divided by the
    query's best. One Python call a query, whose pool is the bounded list that a search returned.
    """
    types = dict(pool.dtypes)

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", key], ascending=[False, True], kind="stable").reset_index(drop=True)
        sets, top = [set(t) for t in rows["tokens"]], max(float(rows["score"].max()), 1e-9)
        left, chosen = list(range(len(rows))), []
        while left and len(chosen) < k:
            def value(i: int) -> float:
                like = max((len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) for j in chosen), default=0.0)
                return float(rows.loc[i, "score"]) / top - alike * like - same * sum(rows.loc[j, "source"] == rows.loc[i, "source"] for j in chosen)

            best = max(left, key=lambda i: (value(i), -i))
            left.remove(best)
            chosen.append(best)
        return pd.DataFrame({qkey: rows.loc[chosen, qkey], key: rows.loc[chosen, key], "pick": range(1, len(chosen) + 1)})

    return pool.select(qkey, key, "score", "tokens", "source").groupBy(qkey).applyInPandas(choose, f"`{qkey}` {types[qkey]}, `{key}` {types[key]}, pick int")
