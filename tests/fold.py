"""An independent model of the ordered fold, over plain Python rows."""

import hashlib

WEIGHT = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1, "unknown": 0}
BLANKS = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))


def identity(f):
    if f.get("fingerprint"):
        return f["fingerprint"]
    ids = f.get("identifiers") or {}
    every = sorted(v.strip(BLANKS).lower() for kind in ("cwe", "cve", "osv", "ghsa") for v in ids.get(kind) or [])
    place = f.get("location") or {}
    line = place.get("start_line")
    parts = [f["category"], f["scanner"].get("rule_id") or "", (place.get("path") or "").lower(), "" if line is None else str(line), ",".join(every), f["title"].strip(BLANKS).lower()]
    return hashlib.sha256("|".join(parts).encode()).hexdigest()


def correlate(findings):
    """Groups in rank order: fingerprint, primary, duplicates, sources."""
    groups = {}
    for f in findings:
        key = identity(f)
        source = (f["scanner"].get("name") or "") + ":" + (f["scanner"].get("rule_id") or "")
        if key not in groups:
            groups[key] = {"fingerprint": key, "primary": f, "duplicates": [], "sources": {source: f["scanner"]}}
            continue
        g = groups[key]
        level = lambda x: (WEIGHT[x["severity"]], x["confidence"])
        if level(f) > level(g["primary"]):
            g["duplicates"].append(g["primary"])
            g["primary"] = f
        else:
            g["duplicates"].append(f)
        g["sources"].setdefault(source, f["scanner"])
    return sorted(groups.values(), key=lambda g: (-WEIGHT[g["primary"]["severity"]], -g["primary"]["confidence"]))
