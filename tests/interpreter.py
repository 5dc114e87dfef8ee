"""The scan's rules, one document after the other, in plain Python."""

import re
from collections import Counter, defaultdict


def scan(docs, cfg):
    """docs: dicts in scan order. Returns kept hits and counters."""
    compiled = [(p, re.compile(p.source, re.I)) for p in sorted(cfg.patterns, key=lambda p: p.ord)]
    out = {"docs_scanned": 0, "docs_minlen": 0, "capped_removed": 0, "by_term": Counter(), "domains": set(), "hit_domains": set(), "top": Counter()}
    used, kept = defaultdict(int), []
    for d in docs:
        out["docs_scanned"] += 1
        text = d["text"]
        if len(text) < cfg.min_chars:
            continue
        out["docs_minlen"] += 1
        domain = d["registered_domain"]
        if domain:
            out["domains"].add(domain)
        for p, rx in compiled:
            m = rx.search(text)
            if not m:
                continue
            around = text[max(0, m.start() - cfg.window) : min(len(text), m.end() + cfg.window)]
            if p.ambiguous and cfg.needle not in around.lower():
                continue
            if domain:
                key = (d["crawl_id"], domain)
                if used[key] >= cfg.domain_cap:
                    out["capped_removed"] += 1
                    continue
                used[key] += 1
                out["hit_domains"].add(domain)
                out["top"][domain] += 1
            out["by_term"][p.label] += 1
            kept.append((d["record_idx"], p.label, m.start(), m.end(), " ".join(around.split())))
    return kept, out
