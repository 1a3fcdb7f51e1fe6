"""Reports of findings as text, JSON, Markdown, JUnit, SARIF and PDF. They render rows that the driver holds."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame

from siftstone.operators import rollups

TOOL = "siftstone"
ORDER = ("critical", "high", "medium", "low", "info")
LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}


#: Findings that a report lists unless asked for more; its counts are of all, and it says how many it leaves out.
LISTED = 100_000


class Analysis(NamedTuple):
    findings: list[dict]
    files: int
    scans: int
    counts: list[tuple[str, int]]
    risk: int
    hotspots: list[dict]
    total: int | None = None

    @property
    def n(self) -> int:
        return len(self.findings) if self.total is None else self.total

    @property
    def unlisted(self) -> int:
        return self.n - len(self.findings)


def analysis(findings: DataFrame, files: int, scans: int, most: int = LISTED) -> Analysis:
    """What a report says. Counts and places are of all findings; the first ``most`` (in the order given) are listed, which the driver
    has to hold. ``rows.write`` writes them all, from the executors."""
    counts = {r["severity"]: r["n"] for r in rollups.severity_counts(findings).collect()}
    return Analysis([r.asDict() for r in findings.limit(most).collect()], files, scans, [(s, counts[s]) for s in ORDER if s in counts], rollups.risk_score(findings).first()["risk"], [r.asDict() for r in rollups.hotspots(findings).collect()], findings.count())


def fit(text: str, width: int | None, keep: str = "left") -> str:
    """Text within a number of columns, an ellipsis where it was cut; ``keep`` says which end stays."""
    if width is None or len(text) <= width:
        return text
    if width <= 1:
        return "…"[:width]
    return text[: width - 1] + "…" if keep == "left" else "…" + text[-(width - 1) :]


def _line(f: dict, width: int | None) -> str:
    place = f"{f['path']}:{f['line']}:{f['col']}"
    head = f"[{f['rule']}] {f['severity'] or 'info'} "
    if width is None:
        return f"{head}{place} {f['snippet']}"
    place = fit(place, max(10, width // 2 - len(head)), "right")
    return fit(f"{head}{place} {f['snippet']}", width)


def summary(a: Analysis, width: int | None = None) -> str:
    out = [f"{a.n} finding(s) across {a.files} file(s), {a.scans} scan(s); risk score {a.risk}"]
    out += [f"{a.unlisted} of them not listed"] * bool(a.unlisted)
    out += [f"  {s:<8} {n}" for s, n in a.counts]
    if a.hotspots:
        shared = rollups.common_directory([h["directory"] for h in a.hotspots])
        out.append("hotspots" + (f" under {shared}/" if shared else "") + ":")
        for h in a.hotspots:
            name = h["directory"].removeprefix(f"{shared}/") if shared else h["directory"]
            out.append(fit(f"  {h['findings']:>5}  {h['share'] * 100:5.1f}%  risk {h['risk']:>5}  {name}", width))
    return "\n".join(out) + "\n"


def as_text(a: Analysis, width: int | None = None) -> str:
    return "".join(_line(f, width) + "\n" for f in a.findings) + "\n" + summary(a, width)


def as_json(a: Analysis) -> str:
    head = {"findings": a.n, "unlisted": a.unlisted, "files": a.files, "scans": a.scans, "risk_score": a.risk, "severity": dict(a.counts)}
    return json.dumps({"summary": head, "findings": a.findings, "hotspots": a.hotspots}, indent=2, ensure_ascii=False) + "\n"


def cell(text: object) -> str:
    """A value for one cell of a Markdown table."""
    out = str(text if text is not None else "").replace("|", "\\|").replace("`", "\\`")
    return re.sub(r"[\x00-\x1f]", " ", out)


def as_markdown(a: Analysis) -> str:
    out = ["# Findings", "", f"{a.n} finding(s), risk score {a.risk}" + f"; {a.unlisted} of them not listed" * bool(a.unlisted), "", "| severity | n |", "|-|-|", *[f"| {s} | {n} |" for s, n in a.counts], "", "| severity | rule | place | cwe | snippet |", "|-|-|-|-|-|"]
    out += [f"| {cell(f['severity'] or 'info')} | {cell(f['rule'])} | {cell(f['path'])}:{f['line']}:{f['col']} | {cell(f['cwe'])} | {cell(f['snippet'])} |" for f in a.findings]
    out += ["", "| directory | findings | risk | share |", "|-|-|-|-|", *[f"| {cell(h['directory'])} | {h['findings']} | {h['risk']} | {h['share'] * 100:.1f}% |" for h in a.hotspots]]
    return "\n".join(out) + "\n"


def xml(text: str) -> str:
    """Text for XML: escaped, control signs as spaces."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = text.replace(sign, name)
    return re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", " ", text)


def as_junit(a: Analysis) -> str:
    n = a.n
    out = ['<?xml version="1.0" encoding="UTF-8"?>', f'<testsuites name="{TOOL}" tests="{n}" failures="{n}">', f'  <testsuite name="{TOOL}" tests="{n}" failures="{n}">']
    for f in a.findings:
        severity = f["severity"] or "info"
        name = xml(f"{f['rule']} at {f['path']}:{f['line']}:{f['col']}")
        message = xml(f"[{f['rule']}] {severity}" + (f" ({f['cwe']})" if f["cwe"] else ""))
        out += [f'    <testcase name="{name}" classname="{xml(f["path"])}">', f'      <failure message="{message}" type="{severity}">{xml(f["snippet"])}</failure>', "    </testcase>"]
    out += [f"    <!-- {a.unlisted} failure(s) not listed -->"] * bool(a.unlisted)
    return "\n".join([*out, "  </testsuite>", "</testsuites>"]) + "\n"


def as_sarif(a: Analysis) -> str:
    """SARIF 2.1.0: rules in the order in which they are first seen; a region only for findings with a line."""
    rules: dict[str, dict] = {}
    results = []
    for f in a.findings:
        if f["rule"] not in rules:
            rules[f["rule"]] = {"id": f["rule"], "name": f["rule"], "shortDescription": {"text": f["rule"]}} | ({"properties": {"cwe": f["cwe"], "tags": [f["cwe"]]}} if f["cwe"] else {})
        place: dict = {"artifactLocation": {"uri": f["path"]}}
        if f["line"] >= 1:
            place["region"] = {"startLine": f["line"]} | ({"startColumn": f["col"]} if f["col"] >= 1 else {}) | ({"snippet": {"text": f["snippet"]}} if f["snippet"] else {})
        results.append({"ruleId": f["rule"], "ruleIndex": list(rules).index(f["rule"]), "level": LEVELS.get(f["severity"], "warning"), "message": {"text": f["snippet"] or f["rule"]}, "locations": [{"physicalLocation": place}]})
    driver = {"name": TOOL, "version": "1.0", "rules": list(rules.values())}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": driver}, "results": results} | ({"properties": {"unlisted": a.unlisted}} if a.unlisted else {})]}, indent=2, ensure_ascii=False) + "\n"


def as_pdf(a: Analysis) -> bytes:
    """The text report on A4 pages, in a fixed-width font; signs beyond Latin-1 as question marks."""
    lines = as_text(a, 96).splitlines()
    pages = [lines[i : i + 60] for i in range(0, max(1, len(lines)), 60)]
    parts: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>"]
    kids = []
    for page in pages:
        safe = [re.sub(rb"([\\()])", rb"\\\1", x.replace("•", "\x95").replace("…", "\x85").encode("latin-1", "replace")) for x in page]
        body = b"BT /F1 9 Tf 11 TL 40 800 Td " + b" ".join(b"(" + x + b") Tj T*" for x in safe) + b" ET"
        kids.append(len(parts) + 1)
        parts.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (len(parts) + 2))
        parts.append(b"<< /Length %d >>\nstream\n" % len(body) + body + b"\nendstream")
    parts[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, part in enumerate(parts, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % i + part + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(parts) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(parts) + 1, start))


FORMATS: dict[str, Callable[[Analysis], str | bytes]] = {"text": as_text, "summary": summary, "json": as_json, "markdown": as_markdown, "junit": as_junit, "sarif": as_sarif, "pdf": as_pdf}


def render(a: Analysis, kind: str) -> str | bytes:
    """A report; ValueError for a format there isn't."""
    if kind not in FORMATS:
        raise ValueError(f"no format {kind!r}: use one of {', '.join(FORMATS)}")
    return FORMATS[kind](a)
