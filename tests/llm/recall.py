"""Recall of op1 against brute force on one of the driver's tables: python tests/llm/recall.py [sf_dir].

The brute force knows nothing of minima and bands: full sets of words as text,
candidates by an exact prefix filter, all of them confirmed, union-find.
"""

import re
import sys
import time
from collections import Counter, defaultdict

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])


def components(rows, width, percent):
    sets, root, copies = {}, {i: i for i, _ in rows}, {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def union(a, b):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)

    for i, text in sorted(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        s = frozenset(" ".join(words[k : k + width]) for k in range(len(words) - width + 1)) if len(words) >= width else frozenset([" ".join(words)] if words else [])
        if s in copies:
            union(copies[s], i)
        elif s:
            copies[s] = i
            sets[i] = s
    often = Counter(x for s in sets.values() for x in s)
    index, links = defaultdict(list), 0
    for i in sorted(sets, key=lambda i: (len(sets[i]), i)):
        s = sets[i]
        rare = sorted(s, key=lambda x: (often[x], x))[: len(s) - -(-percent * len(s) // 100) + 1]
        for j in {j for x in rare for j in index[x] if 100 * len(sets[j]) >= percent * len(s)}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                links += 1
                union(i, j)
        for x in rare:
            index[x].append(i)
    return {i: find(i) for i in root}, links


if __name__ == "__main__":
    import duckdb
    from pyspark.sql import SparkSession

    from tidemark.llm import dedup

    at = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    rows = duckdb.sql(f"select doc_id, text from '{at}/documents.parquet'").fetchall()
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").getOrCreate()
    for width in (2, 5):
        began = time.time()
        want, links = components(rows, width, 80)
        middle = time.time()
        got = {r.doc_id: r.component_id for r in dedup.near_duplicates(spark.read.parquet(f"{at}/documents.parquet"), width=width).collect()}
        joined = [i for i, r in want.items() if r != i]
        print(f"width {width}: {len(rows)} documents, {links} links between different sets, {sum(got[i] == want[i] for i in want)} components equal, "
              f"recall {sum(got[i] != i for i in joined) / max(1, len(joined)):.6f}, joined in error {sum(got[i] != i for i in want if want[i] == i)}; "
              f"brute force {middle - began:.0f} s, operator {time.time() - middle:.0f} s")
