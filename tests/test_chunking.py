import random

from pyspark.sql import functions as F

from lodestone.operators import chunking


def split(text, most):
    if len(text) <= most:
        return [text]
    out, cur = [], ""
    for w in text.split(" "):
        if cur and len(cur) + len(w) + 1 > most:
            out.append(cur)
            cur = w
        else:
            cur = f"{cur} {w}" if cur else w
    return out + [cur] if cur else out


def pack(blocks, most, overlap):
    cur, length, out = [], 0, []
    for page, text in [(p, t) for p, b in blocks for t in split(b, most)]:
        if cur and length + len(text) + 2 > most:
            out.append(cur)
            kept, total = [], 0
            while overlap and len(kept) < len(cur) and total < overlap:
                b = cur[-1 - len(kept)]
                total += len(b[1]) + (2 if kept else 0)
                kept.insert(0, b)
            cur, length = kept, total
        cur = cur + [(page, text)]
        length += len(text) + 2
    return out + [cur] if cur else out


def test_packing_is_that_of_a_loop(spark):
    draw = random.Random(5)
    docs = [(f"h{i:03d}", [(n // 3 + 1, " ".join("x" * draw.randint(1, 12) for _ in range(draw.randint(1, 40)))) for n in range(draw.randint(0, 15))]) for i in range(40)]
    rows = [(h, n, "text", p, t) for h, bs in docs for n, (p, t) in enumerate(bs)]
    blocks = spark.createDataFrame(rows, "content_hash string, ord int, label string, page int, text string")
    for most, overlap in ((120, 0), (120, 30), (200, 90)):
        got = {(r["content_hash"], r["chunk_index"]): (r["text"], r["page_start"], r["page_end"]) for r in chunking.chunks(blocks, most, overlap).collect()}
        want = {(h, i): ("\n\n".join(t for _, t in c), min(p for p, _ in c), max(p for p, _ in c)) for h, bs in docs for i, c in enumerate(pack(bs, most, overlap))}
        assert got == want


def test_headings_and_skipped_labels(spark):
    blocks = [("page_header", 1, "Repeated header"), ("section_header", 1, "The Middle-Income Trap"), ("text", 1, "Middle-income countries need investment and infusion."), ("text", 2, "Upper-middle-income countries add innovation.")]
    docs = spark.createDataFrame([("b" * 64, blocks), ("c" * 64, None)], "content_hash string, blocks array<struct<label:string,page:int,text:string>>")
    got = chunking.chunks(chunking.text_blocks(docs), 180, 0).collect()
    assert [(r["chunk_id"], r["page_start"], r["page_end"]) for r in got] == [("b" * 12 + ":text:0000", 1, 2)]
    assert got[0]["text"].startswith("## The Middle-Income Trap\n\nMiddle-income") and "Repeated" not in got[0]["text"]
    assert chunking.chunks(chunking.text_blocks(docs).where(F.lit(False))).count() == 0


def test_documents_in_place(spark):
    schema = "content_hash string, blocks array<struct<label:string,page:int,text:string>>, ord int"
    rows = [(f"h{k}", [("page_header" if i % 7 == 0 else "section_header" if i % 5 == 0 else "text", i // 4, "w" * (i * 13 % 90) + " x" * (i % 40)) for i in range(60)], 1) for k in range(3)]
    rows += [("none", None, 1), ("empty", [], 1), ("blank", [("text", 1, "  "), ("text", 1, None), (None, 1, "x")], 1)]
    docs = spark.createDataFrame(rows, schema)
    for most, overlap in ((180, 0), (300, 80)):
        by_rows = chunking.chunks(chunking.text_blocks(docs), most, overlap).collect()
        in_place = chunking.document_chunks(docs, most, overlap)
        assert sorted(map(tuple, in_place.collect())) == sorted(map(tuple, by_rows)) and len(by_rows) > 10
        assert "Exchange" not in in_place._jdf.queryExecution().executedPlan().toString()
    twice = docs.where("content_hash = 'h1'")
    assert chunking.document_chunks(twice.unionByName(twice), 180, 0).count() == 2 * chunking.document_chunks(twice, 180, 0).count()
