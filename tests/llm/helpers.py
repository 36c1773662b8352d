"""Plain reference versions and odd inputs shared by the tests of the llm operators."""

import re

LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, row string, key long, fp string, held_out string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def odd_docs(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, clashing names."""
    texts = [None, "", " \n\t ", "a", "Straße ÉTÉ 漢字 😀 ok", "one two three four five six seven eight nine ten " * 3000, "x" * 50_000, "dup dup", "dup dup"]
    rows = [(k, t, "en" if k % 2 else None, None if k % 3 else "s", "r", 1, "f", "h") for k, t in enumerate(texts)]
    rows += [(8, "dup dup", "en", "s", "r", 1, "f", "h"), (8, "dup dup", "en", "s", "r", 1, "f", "h"), (None, "null id", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}
