import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, ids=None):
    """A documents frame; ids default to 0, 1, 2, ..."""
    rows = [(i if ids is None else ids[k], t, "en", "s", None if t is None else len(t)) for k, (i, t) in enumerate(enumerate(texts))]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def clashing(docs):
    """docs with further columns that have the names of columns used inside operators."""
    for c in ("shard", "slot", "_row", "score", "label", "rank", "items", "blob", "spans", "start", "n_words", "pos", "cls", "band", "h", "size", "len", "did", "th", "gone", "row", "own", "split", "told", "a", "z", "m", "node", "rep", "root", "_keep", "_score", "_removed", "_node", "_kept", "_rep", "doc", "key", "bands", "copies", "next", "blob2"):
        docs = docs.selectExpr("*", f"'x' AS {c}")
    return docs


def invented(seed=3, n=60, words=40):
    """Texts with exact and near copies, shared passages, empty, null and odd ones."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéñß") for _ in range(r.randint(1, 7))) for _ in range(300)]
    some = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage = some(30)
    out = [None, "", " ", "\n\n", "one", "A b\nA b\nA b", "日本語 テキスト 日本語", "x" * 5000]
    for i in range(n):
        t = some(r.randint(1, words * 3))
        if i % 7 == 0:
            t += "\n" + passage + "\n" + some(5)
        if i % 5 == 0 and len(out) > 12:
            near = out[r.randrange(8, len(out))].split(" ")
            near[r.randrange(len(near))] = "changed"
            t = " ".join(near)
        if i % 11 == 0:
            t = out[r.randrange(8, len(out))] if len(out) > 12 else t
        out.append(t.replace(" b", "\nb"))
    return out


def rows(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}
