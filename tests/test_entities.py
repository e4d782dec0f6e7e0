"""Entity resolution against all pairs."""

import random

from sparkloom.operators import entities as E


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def alike(x, y):
    longer = max(len(x), len(y))
    d = edits(x, y)
    short, long_ = sorted((x, y), key=len)
    return x != y and (d <= 2 and longer >= 4 and d <= 0.3 * longer or len(short) >= 3 and short in long_.split(" "))


def test_pairs_are_those_of_all_pairs(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9)))
    names = {" ".join(word() for _ in range(rnd.choice([1, 1, 2]))) for _ in range(150)}
    known = {" ".join(word() for _ in range(rnd.choice([1, 1, 2]))) for _ in range(100)}
    for stem in ("kubernetes cluster of the north", "postgres" * 6):  # long names, edited anywhere
        known.add(stem)
        for _ in range(30):
            s = list(stem)
            for _ in range(rnd.randint(1, 3)):
                i = rnd.randrange(len(s))
                s[i : i + 1] = rnd.choice([[], [s[i], "x"], ["y"]])
            names.add("".join(s))
    n, k = spark.createDataFrame([(x,) for x in names], "key string"), spark.createDataFrame([(x,) for x in known], "alias string")
    got = {(r.key, r.alias) for r in E.edit_pairs(n, k).unionByName(E.word_pairs(n, k)).collect()}
    assert got == {(x, y) for x in names for y in known if alike(x, y)}


def test_passes(spark):
    known = [("pg", "PostgreSQL", [1.0, 0.0, 0.0]), ("pg", "postgres", [1.0, 0.0, 0.0]), ("k8", "kubernetes", [0.0, 1.0, 0.0]), ("jwt", "json web token", [0.0, 0.0, 1.0]), ("re", "react hooks", None)]
    names = [("Postgres 14", None), ("postgers", None), ("kubernets", None), ("JWT", None), ("hooks", None), ("helm charts", [0.1, 1.0, 0.05]), ("nobody", [1.0, 1.0, 1.0]), ("", None), (None, None), ("JWT", None), ("red", None)]
    k = spark.createDataFrame(known, "entity string, alias string, vector array<double>")
    n = spark.createDataFrame(names, "name string, vector array<double>")
    short = spark.createDataFrame([("jwt", "JSON Web Token")], "short string, long string")
    got = {r.name: (r.entity, r.how) for r in E.resolve(n, k, short).collect()}
    assert got == {
        "Postgres 14": ("pg", "exact"), "postgers": ("pg", "alias"), "kubernets": ("k8", "alias"), "JWT": ("jwt", "alias"), "hooks": ("re", "alias"), "helm charts": ("k8", "embedding"),
        "nobody": (None, "new"), "": (None, "new"), None: (None, "new"), "red": (None, "new"),
    }
    assert {r.how for r in E.resolve(n.drop("vector"), k.limit(0)).collect()} == {"new"}
