"""Single-process comparison point: Python substring tests of every V2 term
against every normalised, lower-cased text (the per-text work the published
detector does before its rule chain; its network passes are not included).

Usage: python scripts/single_process_matching.py [sf_dir]
"""

import sys
import time

import pyarrow.parquet as pq

sys.path.insert(0, __file__.rsplit("/scripts/", 1)[0])
from slantscan.functions import rules_v2  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    texts = pq.read_table(f"{sf}/documents.parquet", columns=["text"]).column("text").to_pylist()
    terms = list(dict.fromkeys(rules_v2.terms()))
    t0 = time.perf_counter()
    hits = 0
    for t in texts:
        low = " ".join((t or "").split()).lower()
        hits += sum(term in low for term in terms)
    dt = time.perf_counter() - t0
    print(f"{len(texts)} texts x {len(terms)} terms: {hits} hits in {dt:.2f} s (one process)")


if __name__ == "__main__":
    main()
