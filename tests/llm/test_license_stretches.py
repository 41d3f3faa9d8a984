"""License scans look for minima only where a template's value stands, and find the same."""

import random

import numpy as np

from lodestone.llm import license_scan


def texts(seed: int, n: int) -> list[bytes]:
    r = random.Random(seed)
    out = []
    for _ in range(n):
        words = [f"w{r.randrange(3000)}" for _ in range(r.choice([0, 3, 40, 400, 4000]))]
        for _ in range(r.randrange(4)):
            t = r.choice(list(license_scan.TEMPLATES.values())).split()
            low = r.randrange(len(t)) if r.random() < 0.3 else 0
            at = r.randrange(len(words) + 1)
            words[at:at] = t[low : low + 60] if r.random() < 0.3 else t
        out.append(" ".join(words).encode())
    return out


def test_stretches_lose_no_window(monkeypatch):
    library = license_scan.Library(license_scan.TEMPLATES)
    rows = [*texts(5, 150), b"", b"filler " * 5000, license_scan.TEMPLATES["MIT-text"].encode() * 3]
    got = license_scan.scan_texts(rows, library, 0.8)
    partly = license_scan.scan_texts(rows, library, 0.3)
    whole = lambda high, bounds, library: (bounds[:-1], bounds[1:], np.arange(len(bounds) - 1))
    monkeypatch.setattr(license_scan, "_stretches", whole)
    assert got == license_scan.scan_texts(rows, library, 0.8) and len(got) > 100
    assert partly == license_scan.scan_texts(rows, library, 0.3) and len(partly) > len(got)


def test_minima_are_taken_near_templates_only(monkeypatch):
    seen, levels = [], license_scan._levels
    monkeypatch.setattr(license_scan, "_levels", lambda bounds, sizes: seen.append(int(bounds[-1])) or levels(bounds, sizes))
    library = license_scan.Library(license_scan.TEMPLATES)
    filler = " ".join(f"w{i}" for i in range(100_000)).encode()
    notice = license_scan.TEMPLATES["GPL-3.0"].encode()
    found = license_scan.scan_texts([filler, filler + b" " + notice + b" " + filler, filler], library, 0.8)
    assert [(i, name, share, at) for i, name, share, at, _ in found if name == "GPL-3.0"] == [(1, "GPL-3.0", 1.0, 100_000)]
    assert sum(seen) <= 6 * max(library.groups)
