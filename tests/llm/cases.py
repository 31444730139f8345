"""Names, rows and frames that the tests share."""

from __future__ import annotations

SMALL = "/root/testdata/sf0.001"
#: Names that operators use inside; as extra columns they must not disturb anything.
CLASHING = ["id", "key", "row", "at", "kept", "score", "doc", "tie", "spans", "copy", "lang_pred", "component_id", "size", "hits"]


def edge_rows() -> list[tuple]:
    passage = "Gross ist die alte Stadt am Fluss, und viele Boote fahren dort an jedem hellen Morgen vorbei. " * 3
    longest = " ".join(f"Wort{k % 977}x{k % 13}" for k in range(40_000))
    return [
        (None, None, None, None), (None, "No id at all, but some text here to read", "en", None), (900_001, None, "en", "src0"),
        (900_002, "", "en", "src0"), (900_003, " \t\n", None, "src1"), (900_004, "!!! 12 ...", "en", "src1"), (900_005, "ein", "de", "edge"),
        (900_006, "EIN", "de", "edge"), (900_007, longest, "de", "edge"), (900_010, passage, "de", "edge"), (900_010, passage, "de", "edge"),
        (900_011, "vorher " + passage.upper() + " nachher", "de", None), (900_012, passage + passage, "de", "edge"),
        (900_013, "Ñandú, élève, naïve – 東京タワー 東京タワー", "es", "edge"), (900_014, "a" * 500, None, "edge"), (900_015, "ab " * 400, None, "edge"),
    ]


def template_rows(percent: int, n: int = 400, pairs: int = 60) -> tuple[list[tuple], int]:
    """``n`` texts on one template, of which any two are just below ``percent`` but for ``pairs`` pairs above it."""
    template = [f"t{k}" for k in range(404)]
    own = {85: 38, 80: 54}[percent]
    rows = []
    for k in range(n):
        twin = k - 1 if k < 2 * pairs and k % 2 else k
        kept = own // 4 if twin != k else 0
        words = [f"d{twin}x{j}" for j in range(kept)] + [f"d{k}x{j}" for j in range(kept, own)]
        rows.append((k, " ".join(template + words), "en", "template"))
    return rows, pairs


def variant_rows(n: int = 200, strays: int = 40) -> list[tuple]:
    """``n`` almost equal texts, and ``strays`` texts of which each is linked, at 85 percent, to one of them only."""
    base = [f"b{k}" for k in range(400)]
    own = lambda k: [f"v{k}x{j}" for j in range(4)]
    rows = [(k, " ".join(base + own(k)), "en", "variants") for k in range(n)]
    return rows + [(n + k, " ".join(base + own(k * n // strays) + [f"s{k}x{j}" for j in range(68)]), "en", "variants") for k in range(strays)]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    for name in CLASHING:
        df = df.withColumn(name, df["source"])
    return df
