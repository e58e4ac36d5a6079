"""Answers as text: for a terminal, as JSON, as HTML; all rows, or as many as a given limit, with their total."""

from __future__ import annotations

import html
import json

from .envelope import Envelope


def as_dict(answer: Envelope, limit: int | None = None) -> dict:
    some = answer.results if limit is None else answer.results.limit(limit)
    rows = [json.loads(r) for r in some.toJSON().toLocalIterator()]
    total = {} if limit is None else {"total": answer.results.count()}
    return total | {"query_type": answer.query, "status": answer.status, "authority": answer.authority, "error_semantic": answer.error_semantic, "source_watermark": answer.watermark, "results": rows, "warnings": answer.warnings, "errors": answer.errors}


def _shown(d: dict) -> str:
    return f", {len(d['results'])} of {d['total']} rows" if "total" in d else ""


def as_json(answer: Envelope, limit: int | None = None) -> str:
    return json.dumps(as_dict(answer, limit), ensure_ascii=False, indent=2)


def as_text(answer: Envelope, limit: int | None = None) -> str:
    d = as_dict(answer, limit)
    head = f"{d['query_type']}: {d['status']}" + (f" ({d['error_semantic']})" if d["error_semantic"] else "") + _shown(d)
    return "\n".join([head, *(f"  {k}: {', '.join(d[k])}" for k in ("errors", "warnings") if d[k]), *("  - " + ", ".join(f"{k}={v}" for k, v in r.items()) for r in d["results"])])


def as_html(answer: Envelope, limit: int | None = None) -> str:
    d = as_dict(answer, limit)
    columns = list(dict.fromkeys(k for r in d["results"] for k in r))
    cell = lambda tag, v: f"<{tag}>{html.escape(str('' if v is None else v))}</{tag}>"
    rows = "".join("<tr>" + "".join(cell("td", r.get(c)) for c in columns) + "</tr>" for r in d["results"])
    return f"<section><h2>{html.escape(d['query_type'])}</h2><p>{html.escape(d['status'] + _shown(d))}</p><table><tr>{''.join(cell('th', c) for c in columns)}</tr>{rows}</table></section>"
