"""Plain Python versions of the operators on general problems, written from the statements alone."""

import re
from collections import Counter, defaultdict

WS = re.compile(r"\s+")


def bare(c):
    if c is None:
        return None
    c = c.strip().upper()
    while c.startswith("CHR"):
        c = c[3:]
    return c


def tab_split(line):
    """Fields of a line with tabs, or None if its quotes are broken."""
    out, i = [], 0
    while True:
        if i < len(line) and line[i] == '"':
            j, text = i + 1, ""
            while True:
                if j >= len(line):
                    return None
                if line[j] == '"':
                    if line[j + 1 : j + 2] == '"':
                        text += '"'
                        j += 2
                        continue
                    break
                text += line[j]
                j += 1
            j += 1
            if j < len(line) and line[j] != "\t":
                return None
            out.append(text)
            i = j
        else:
            j = line.find("\t", i)
            j = len(line) if j < 0 else j
            out.append(line[i:j])
            i = j
        if i >= len(line):
            return out
        i += 1


def body(line):
    return line[:-1] if line.endswith("\r") else line


def digits(x):
    return int(x) if re.fullmatch("[0-9]+", x) else None


def failed(fusion, manifest, chroms):
    out = set()
    for r in fusion:
        if r["raw_line"] is None:
            continue
        b = body(r["raw_line"])
        if not b.strip() or b.startswith("#"):
            continue
        f = tab_split(b)
        if f is None:
            why = "quoting"
        elif len(f) not in (5, 6):
            why = "column_count"
        else:
            f = [x.strip(" ") for x in f]
            ok = f[4] != ""
            for c, p in ((f[0], f[1]), (f[2], f[3])):
                ok = ok and bare(c) in chroms and digits(p) is not None and digits(p) <= chroms[bare(c)]
            why = None if ok else "invalid_value"
        if why:
            out.add(("fusion_raw", r["line_id"], why))
    names = headers(manifest)
    for r in manifest:
        _, why = manifest_line(r, names)
        if why:
            out.add(("manifest_raw", r["line_id"], why))
    return out


def headers(manifest):
    out = {}
    for r in manifest:
        if r["line_no"] == 1:
            b = body(r["raw_line"]).removeprefix("﻿")
            f = (tab_split(b) or b.split("\t")) if "\t" in b else b.split()
            out[r["series"], r["file_no"]] = [x.strip() for x in f]
    return out


def manifest_line(r, names):
    if r["line_no"] == 1 or r["raw_line"] is None:
        return None, None
    b = body(r["raw_line"])
    if not b.strip():
        return None, None
    f = tab_split(b) if "\t" in b else b.split()
    if f is None:
        return None, "quoting"
    if len(f) != len(names.get((r["series"], r["file_no"]), ())):
        return None, "column_count"
    f = [x.strip(" ") for x in f]
    if f[0] == "" or not re.fullmatch(r"[A-Za-z0-9_./-]*\.isoform\.gz", f[1]):
        return None, "invalid_value"
    return f, None


def kind(values):
    values = [v for v in values if v not in ("", "NA", "NULL", ".")]
    if not values:
        return None
    if all(re.fullmatch("[0-9]+", v) for v in values):
        return "integer"
    if all(re.fullmatch(r"[0-9]+|[0-9]+\.[0-9]*|\.[0-9]+", v) for v in values):
        return "decimal"
    if all(re.fullmatch(r"\d{4}-\d\d-\d\d", v) for v in values):
        return "date"
    return "text"


def changes(manifest):
    names = headers(manifest)
    cells = defaultdict(dict)
    for r in manifest:
        f, _ = manifest_line(r, names)
        if f:
            for n, v in list(zip(names[r["series"], r["file_no"]], f))[2:]:
                cells[r["series"], r["file_no"], n].setdefault(f[0], v)
    out = set()
    by = defaultdict(list)
    for s, n in names:
        by[s].append(n)
    for s, nos in by.items():
        nos.sort()
        for p, n in zip(nos, nos[1:]):
            old, new = names[s, p][2:], names[s, n][2:]
            gone, come = [x for x in old if x not in new], [x for x in new if x not in old]
            match = []
            for a in gone:
                for b in come:
                    x, y = cells[s, p, a], cells[s, n, b]
                    both = [(x[k], y[k]) for k in x if k in y and x[k] not in ("", "NA", "NULL", ".") and y[k] not in ("", "NA", "NULL", ".")]
                    if both and all(u == v for u, v in both):
                        match.append((a, b, len(both)))
            used = set()
            for a, b, _ in sorted(match, key=lambda m: -m[2]):
                if ("o", a) not in used and ("n", b) not in used:
                    used |= {("o", a), ("n", b)}
                    out.add((s, n, "renamed", a, b))
            out |= {(s, n, "removed", a, "") for a in gone if ("o", a) not in used}
            out |= {(s, n, "added", "", b) for b in come if ("n", b) not in used}
            for x in set(old) & set(new):
                a, b = kind(cells[s, p, x].values()), kind(cells[s, n, x].values())
                if a and b and a != b:
                    out.add((s, n, "retyped", x, x))
    return out


def periods(spans, longest=None):
    by = defaultdict(list)
    for k, s, e in spans:
        if all(k) and s is not None and e is not None and e > s:
            by[k].append((s, e))
    out = set()
    for k, v in by.items():
        merged = []
        for s, e in sorted(v):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(e, merged[-1][1])
            else:
                merged.append([s, e])
        out |= {(k, "period", s, e) for s, e in merged}
        out |= {(k, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:]) if longest is None or b[0] - a[1] <= longest}
    return out


def pieces(text, separators, joiners=""):
    """Pieces with numbers, character by character."""
    seps, white = set(separators) - {" "}, " " in separators
    text = text.strip()
    if not text:
        return []

    def quoted(i):
        q, j, got = text[i], i + 1, ""
        while j < len(text):
            if text[j] == q:
                if text[j + 1 : j + 2] == q:
                    got += q
                    j += 2
                    continue
                after = text[j + 1 : j + 2]
                return (got, j + 1) if after == "" or after in seps or after.isspace() else None
            got += text[j]
            j += 1
        return None

    out, n, i = [], 1, 0
    while i < len(text):
        if text[i] in "\"'" and (g := quoted(i)):
            piece, i = g
        else:
            piece, key = "", None
            while i < len(text) and text[i] not in seps:
                if text[i].isspace():
                    j = i
                    while text[j].isspace():
                        j += 1
                    if white or text[j] in seps:
                        break
                if key is None and piece and joiners and (m := re.compile(rf"\s*[{re.escape(joiners)}]\s*|\s+").match(text, i)):
                    key, piece, i = piece, "", m.end()
                    if i < len(text) and text[i] in "\"'" and (g := quoted(i)):
                        piece, i = g
                        break
                    continue
                piece += text[i]
                i += 1
            if key is not None:
                piece = f"{key}:{piece}"
        if piece != "":
            out.append((n, piece))
        while i < len(text) and text[i].isspace():
            i += 1
        if i < len(text) and text[i] in seps:
            i += 1
        while i < len(text) and text[i].isspace():
            i += 1
        n += 1
    return out


def keyed(records):
    seen = {r["rec_id"]: r for r in records if r["signature"] is not None and r["chrom_id"] is not None}
    out = {}
    for r in seen.values():
        o = out.setdefault((r["signature"], r["chrom_id"]), [0, 0, []])
        o[0] += 1
        o[1] += r["total_evidence"] or 0
        for i, v in enumerate(r["sample_evidence_arr"] or []):
            if i >= len(o[2]):
                o[2].append(0)
            o[2][i] += v or 0
    return out


def hot(records):
    seen = {r["rec_id"]: (r["signature"], r["chrom_id"]) for r in records if r["signature"] is not None and r["chrom_id"] is not None}
    n = Counter(seen.values())
    return {k for k, v in n.items() if v * 100 >= len(seen)}
