"""Small documents with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing column names."""
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, _size int, sequence_id string"


def words(n: int, seed: int) -> str:
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (1103515245 * x + 12345) % (1 << 31)
        out.append("".join("aeioubcdfglmnprst"[(x >> s) % 17] for s in range(3, 3 + 3 * (2 + x % 4), 3)))
    return " ".join(out)


def rows() -> list[tuple]:
    base = [words(60 + i % 40, i) for i in range(60)]
    texts = [*base, base[0], base[0], base[3], "", None, " \n ", "one", "one", "one two three four five", words(9000, 99), base[7].replace(" ", "  "), base[9] + " tail",
             " ".join(base[11].split()[1:]), base[13] + ".", "é" + base[14], "Ünï çödé 漢字 🙂 " * 5, "x" * 30_000]
    found = [(i, t, "en", f"s{i % 3}" if i % 5 else None, None, "k", 1, "z") for i, t in enumerate(texts)]
    return [*found, found[2], found[2], (None, base[0], None, "", 4, None, None, None), (None, None, None, None, None, None, None, None)]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
