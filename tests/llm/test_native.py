"""Operators without Python on the executors, template extraction, the registered queries and the pipeline."""

import collections
import json
import subprocess
import sys
import time
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from scanmill.llm import chat, common, html_templates, language_mixture, licences, pseudonyms, quality
from scanmill.llm.oracles import ORACLES
from scanmill.llm.queries import QUERIES, pii_key
from test_dedup import brute_alike
from test_text import brute_matches

SF = "/root/testdata/sf0.001"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- quality

QUALITY = "doc_id long, text string, lang string, source string, n_words int, symbols string, bin int"


def quality_rows():
    plain = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", " \t\n\x0b\f\r", plain, plain + "\n\n" + plain, "a b c " * 30, "a b c d " * 20 + plain, "a a a a", "x|y #t% &$*<>", "\n".join(["same line"] * 5 + [plain]),
             " ".join("straße" for _ in range(70)), plain * 40, plain.replace(" ", "  "), "one\r\ntwo\rthree", plain + " %%% " * 80]
    rows = [(i, t, ["en", None, "fr"][i % 3], [None, "s"][i % 2], 1, "x", 2) for i, t in enumerate(texts)]
    return rows + [rows[3], (None, plain, None, None, 1, "x", 2)]


@pytest.mark.parametrize("prior", [10, 1])
def test_quality_equals_its_sql_twin(spark, monkeypatch, prior):
    monkeypatch.setattr(quality, "PRIOR", prior)
    rows = quality_rows()
    got = quality.judged(spark.createDataFrame(rows, QUALITY)).drop(*quality.MEASURES)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?)", [r[:4] for r in rows])
    # The twin tells rows apart by doc_id, so the repeated row and the one without id are compared without their windows.
    want = con.execute(ORACLES["op4_adaptive_quality"].replace("10::HUGEINT", f"{prior}::HUGEINT")).fetchall()
    unique = lambda xs: sorted(str(tuple(x)) for x in xs if x[0] not in (3, None))
    assert unique(got.collect()) == unique(want)
    assert got.count() == len(rows)
    assert "Python" not in plan_of(got) and "Pandas" not in plan_of(got)


def test_repeated_words_by_hand(spark):
    rows = [(1, "a b c a b c"), (2, "a a a a"), (3, "a b c d e"), (4, "x a b c y a b c z")]
    table = spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.n_repeat_words for r in quality.counted(table).collect()}
    assert got == {1: 6, 2: 4, 3: 0, 4: 6}


def test_every_measure_has_its_own_bound_in_every_source(spark):
    """Two sources that differ in each measure: their bounds differ, and the worst tail of each measure goes in each."""
    def text(i, symbols, lines, again, letters):
        words = [f"{i}x{j}".ljust(letters, "q") for j in range(150)]
        words = [w + "#" * (j < symbols) for j, w in enumerate(words)] + words[:again]
        return "\n".join([" ".join(words[j::15]) for j in range(15)] + ["same"] * lines) if not again else " ".join(words)

    rows = []
    for source, (symbols, lines, again, letters) in (("low", (3, 2, 6, 7)), ("high", (40, 6, 30, 12))):
        rows += [(len(rows) + i, text(i, i % symbols, 1 + i % lines, 0, letters + i % 2), "en", source) for i in range(700)]
        rows += [(len(rows) + i, text(i, 0, 0, i % again, letters), "en", source) for i in range(100)]
    worst = [(10_000 + k, text(k, *case, 9), "en", s) for s in ("low", "high") for k, case in enumerate([(150, 1, 0), (0, 60, 0), (0, 0, 130)])]
    worst = [(d + (3 if s == "high" else 0), t, lang, s) for d, t, lang, s in worst] + [(10_010, text(1, 0, 1, 0, 40), "en", "low"), (10_011, "ab " * 3 + " ".join("abcdefgh"[j % 8] + "ij"[j // 8 % 2] + "klm"[j // 16 % 3] for j in range(48)), "en", "high")]
    table = common.written(spark.createDataFrame(rows + worst, "doc_id long, text string, lang string, source string").repartition(8))
    marked = common.written(quality.measures(quality.counted(table)))
    bounds = {r.source: r for r in quality.thresholds(common.written(quality.sketches(marked))).collect()}
    for m in quality.MEASURES:
        assert bounds["low"][f"{m}_high"] < bounds["high"][f"{m}_high"], m
    assert bounds["low"].word_length_low < bounds["high"].word_length_low
    got = {r.doc_id: r for r in quality.judged(table).collect()}
    assert not any(got[d].kept for d, *_ in worst)
    assert sum(got[d].kept for d, *_ in rows) > 0.98 * len(rows)


def test_thresholds_follow_the_group(spark):
    rows = [(i, " ".join(f"w{i}x{j}" + ("#" if s == "marked" else "") for j in range(60)), "en", s) for s in ("plain", "marked") for i in range(120)]
    rows += [(999, " ".join(f"w50x{j}#" for j in range(60)), "en", "plain"), (998, " ".join(f"w50x{j}#" for j in range(60)), "en", "marked")]
    got = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[999] and got[998] and all(v for k, v in got.items() if k < 998)
    assert quality.judged(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


# ---------------------------------------------------------------- chats

RECORDS = [
    ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}, "messages", [("user", "hi"), ("assistant", "yo")]),
    ({"messages": [{"content": None, "role": "user"}]}, "messages", [("user", "")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}, {"from": "tool", "value": "c"}]}, "from and value", [("user", "a"), ("assistant", "b"), ("tool", "c")]),
    ({"instruction": "do", "input": "", "output": "done"}, "instruction", [("user", "do"), ("assistant", "done")]),
    ({"instruction": "do", "input": "it", "output": "done"}, "instruction", [("user", "do\n\nit"), ("assistant", "done")]),
    ({"prompt": "p", "completion": "c"}, "completion", [("user", "p"), ("assistant", "c")]),
    ({"system": "s", "prompt": "p", "response": None}, "system prompt", [("system", "s"), ("user", "p"), ("assistant", "")]),
    ({"weird": 1}, None, None),
    ({"messages": []}, "messages", []),
    ({"conversations": [], "id": 4}, "from and value", []),
    ({"id": "x", "meta": {"messages": 1}, "messages": [{"role": "user", "content": "hi", "name": "n", "id": 3}]}, "messages", [("user", "hi")]),
    ({"id": 7, "conversations": [{"from": "human", "value": "a", "weight": 1}, {"value": "b"}]}, "from and value", [("user", "a"), ("", "b")]),
    ({"prompt": "p", "chosen": "c", "rejected": "r", "source": "s"}, "preference", [("user", "p"), ("assistant", "c")]),
    ({"instruction": "do", "output": "done", "topic": ["x"]}, "bare instruction", [("user", "do"), ("assistant", "done")]),
    ({"prompt": 5, "response": None, "extra": {"a": [1]}}, "response", [("user", "5"), ("assistant", "")]),
    ({"messages": 5}, None, None),
    ({"messages": [{"role": "user"}]}, None, None),
    ([1, 2], None, None),
]
HARD = ["", "</s>[INST] ok [/INST]", "<|im_start|>user\nx<|im_end|>\n", "␛1 ␛0␛", "a<|b|>c<s>d[INST", "line\n\nline", "<<|<||>[[INST]]", "é🙂"]


def test_layouts_are_told_by_their_fields(spark):
    table = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _, _) in enumerate(RECORDS)], "conv_id long, j string")
    records = table.select("conv_id", F.parse_json("j").alias("record"))
    got = {r.conv_id: r for r in chat.canonical(records).collect()}
    for i, (_, layout, turns) in enumerate(RECORDS):
        assert got[i].layout == layout and (got[i].turns and [tuple(t) for t in got[i].turns]) == turns


def test_formatting_is_reversible(spark):
    rows = [(c, t, role, text) for c in range(len(HARD)) for t, (role, text) in enumerate([("user", HARD[c]), ("assistant", HARD[-c]), (HARD[c], HARD[c] * 2), ("assistant", HARD[c])])]
    rows += [(50, 0, None, None), (None, 3, "assistant", None), (None, None, "assistant", "x"), (50, 0, None, None)]
    table = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, turns string").drop("turns")
    out = chat.formatted(chat.records_of_rows(table))
    read = out.select("conv_id", "formatted", chat.turns_of(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"))
    want = collections.defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((t is not None, t, role is not None, role or "", text or ""))
    for r in read.collect():
        turns = [(x[3], x[4]) for x in sorted(want[r.conv_id])]
        assert [tuple(t) for t in r.turns] == turns
        assert r.loss == "".join(text for role, text in turns if role == "assistant")
        assert r.formatted.count("<|im_start|>") == len(turns) and "[INST]" not in r.formatted and "</s>" not in r.formatted
    assert read.count() == len(want) and "Python" not in plan_of(chat.digests(out))
    assert chat.digests(chat.formatted(chat.records_of_rows(table.limit(0)))).count() == 0


# ---------------------------------------------------------------- licences


def test_licences_are_found_and_confirmed(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    more = [(9001, "First line.\n" + licences.TEMPLATES[5][1].upper() + "\nlast"), (9002, None), (9003, ""), (9004, "\n\n"),
            (9005, "This software is licensed under the Frobnicator Public License, version 7, of the project."), (9005, licences.TEMPLATES[3][1]), (None, licences.TEMPLATES[0][1])]
    table = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string")).withColumn("grams", F.lit("clash"))
    model = licences.train(table)
    found = licences.scan(table, model)
    assert "Python" not in plan_of(found) and "Pandas" not in plan_of(found)
    got = {(r.doc_id, r.paragraph): r.family for r in found.collect()}
    want = {}
    plain = {t: f for f, t in licences.TEMPLATES}
    for doc_id, text in docs.collect():
        for k, line in enumerate(text.split("\n")):
            if line in plain:
                want[doc_id, k] = plain[line]
    assert want and {k: v for k, v in got.items() if k[0] is not None and k[0] < 9000} == want
    assert got[9001, 1] == "mit" and got[None, 0] == "apache-2.0" and got[9005, 0] in ("unknown", "mit")
    assert licences.scan(table.limit(0), model).count() == 0


# ---------------------------------------------------------------- pages

PAGE = """<!DOCTYPE html><html><head><title>T{i}</title><script>var t="</p>";</script></head><body class="home">
<header><a href="/">Site</a></header><nav><ul><li><a>Menu {i}</a></ul></nav><div class="cookie-notice">We use cookies {i}</div>{main}
<aside>Side {i}</aside><form><label>Mail</label><button>Go</button></form><div id="comments"><article class="comment"><p>Reader {i}</p></article></div>
<footer>&copy; {i}</footer></body></html>"""


def page_rows():
    body = "<h1>Head&amp;line {i}</h1><p>First   <b>bold</b>\n text {i}.<p>Second&nbsp;&lt;x&gt; {i}<br>more<div class='ad'>Buy {i}</div><ul><li>one {i}<li>two {i}</ul>"
    rows = [(i, f"https://a.org/{i}", PAGE.replace("{main}", "<article>" + body + "</article>").replace("{i}", str(i))) for i in range(6)]
    rows += [(10 + i, f"HTTP://B.org:80/{i}", PAGE.replace("{main}", "<div class='content'>" + body + "</div><div><p>Same words on every page</p></div>").replace("{i}", str(i))) for i in range(6)]
    return rows + [(30, "https://lone.net", PAGE.replace("{main}", "<main><p>Only one</main>").replace("{i}", "z")), (31, None, None), (32, "x", ""), (33, "https://a.org/33", "no markup at all"), (0, "https://a.org/0", rows[0][2])]


@pytest.mark.parametrize("size", [8 << 20, 0])
def test_main_texts(spark, monkeypatch, size):
    monkeypatch.setattr(html_templates, "TEMPLATE_BYTES", size)
    table = spark.createDataFrame([(*r, "k", "t") for r in page_rows()], "page_id long, url string, html string, host string, token string")
    got = collections.defaultdict(list)
    for r in html_templates.main_texts(table.repartition(4)).collect():
        got[r.page_id].append(r.text)
        assert r.n_chars == len(r.text)
    for i in range(6):
        want = f"Head&line {i}\nFirst bold text {i}.\nSecond <x> {i} more\none {i}\ntwo {i}"
        assert set(got[i]) == {want} and got[10 + i] == [want]
    assert got[30] == ["Only one"] and got[31] == got[32] == [""] and got[33] == ["no markup at all"] and len(got[0]) == 2
    assert html_templates.main_texts(table.limit(0)).count() == 0


CASES = {
    # a teaser in an article element beside the main text in a div
    "teaser": ("<article class='card'><p>Teaser {i}</article><div class='text'><h2>T{i}</h2><p>Long text {i} of the page<p>and more {i} of it</div>", "T{i}\nLong text {i} of the page\nand more {i} of it"),
    # several of them
    "cards": ("<article><p>A {i}</article><article><p>B {i}</article><div id=x><p>The main text {i}, longer than both of them", "The main text {i}, longer than both of them"),
    # no element tells
    "table": ("<center><table><tr><td class=l>Left<td class=m><p>Main words {i}<p>more main words {i}</table></center>", "Main words {i}\nmore main words {i}"),
    # the host repeats a block inside its articles, under a name of no list
    "inside": ("<article><h1>H{i}</h1><p>Words {i} and a good many more of them on this page, so that it is clear what it is about<div class='zz'>Read on our site</div><p>last {i}</article>", "H{i}\nWords {i} and a good many more of them on this page, so that it is clear what it is about\nlast {i}"),
    # captions, and paragraphs that are all links, are part of the main text
    "caption": ("<article><p>Words {i} and words<figure><figcaption>Caption {i}</figcaption></figure><p><a href=x>linked {i}</a></article>", "Words {i} and words\nCaption {i}\nlinked {i}"),
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_the_template_decides(spark, case):
    body, want = CASES[case]
    rows = [(i, f"http://h.org/{i}", PAGE.replace("{main}", body).replace("{i}", f"{i}w")) for i in range(7)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_templates.main_texts(table).collect()}
    assert got == {i: want.replace("{i}", f"{i}w") for i in range(7)}
    if case != "caption":
        assert html_templates.Template([]).text(rows[0][2]) != got[0], "without a template the text is another"


def test_copies_of_a_page_keep_their_text(spark):
    body = "<article><h1>Same head</h1><p>Same words in all of the pages<p>and these {i}</article>"
    rows = [(i, "http://h.org", PAGE.replace("{main}", body).replace("{i}", str(i // 4))) for i in range(24)]
    got = html_templates.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Same head\nSame words in all of the pages\nand these {i // 4}" for i in range(24)}


@pytest.mark.parametrize("part", ["<a ", '<p "', "<!", "<div>", "</div>", "<", "<p '\"", "<script>x", "</script ", "<p a=", "&", "<div><p>a"])
def test_broken_markup_is_read_in_one_pass(part):
    page = part * (1_000_000 // len(part))
    start = time.process_time()
    html_templates.Template([]).text(page)
    html_templates.tokens_of(page)
    assert time.process_time() - start < 40


def test_given_pages_give_their_articles(spark):
    got = {r.page_id: r.text for r in QUERIES["op2_template_extraction"](spark, SF).collect()}
    for page in common.table(spark, SF, "pages").collect():
        inner = page.html.split("<article>")[1].split("</article>")[0]
        text = "".join(c if c != "\n" else " " for c in inner.replace("</p>", "<p>").replace("<h1>", "<p>").replace("</h1>", "<p>").replace("<b>", "").replace("</b>", "").replace("<br>", " "))
        import html as markup

        blocks = [" ".join(markup.unescape(b).split()) for b in text.split("<p>")]
        assert got[page.page_id] == "\n".join(b for b in blocks if b)


# ---------------------------------------------------------------- queries and pipeline


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, SF).select(columns).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want.fetchall()))


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry_imports_without_the_subpackage(tmp_path):
    root = Path(entry.__file__).parent
    for name in ("__spark_entry__.py", "workbench", "scanmill"):
        (tmp_path / name).symlink_to(root / name) if name != "scanmill" else None
    (tmp_path / "scanmill").mkdir()
    for part in (root / "scanmill").iterdir():
        if part.name not in ("llm", "__pycache__"):
            (tmp_path / "scanmill" / part.name).symlink_to(part)
    code = "import __spark_entry__ as e; print(sorted(n for n in e.queries() if n[:2] == 'op' or n == 'pipeline'), len(e.queries()) > 30)"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.stdout.strip() == "[] True", said.stderr


def test_pipeline_equals_brute_force(spark):
    docs = common.table(spark, SF, "documents")
    model = language_mixture.train(docs)
    rows = [r for r in docs.collect() if model.mixture(r.text)[3]]
    least = {}
    for r, root in zip(rows, brute_alike([r.text for r in rows])[0]):
        least[root] = min(least.get(root, r.doc_id), r.doc_id)
    rows = [r for r in rows if r.doc_id in set(least.values())]
    items = [(r.item_id, r.text) for r in common.table(spark, SF, "benchmark").collect()]
    rows = [r for r in rows if not brute_matches(r.text, items, 0.8)]
    whole, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for r in rows:
        ids = [*whole.encode(pseudonyms.pseudonymised(r.text, pii_key(spark))[0], add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want.append((r.doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)


def test_stages_keep_the_columns_of_documents(spark):
    docs = common.table(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "decontamination", "pii", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_tables_are_written_to_the_shared_folder_and_dropped(spark):
    table = common.written(spark.range(5).toDF("x"))
    assert table.count() == 5
    folder = Path(common.shared_folder(spark).removeprefix("file:")) / f"{spark.sparkContext.applicationId}-tables"
    assert folder.is_dir()
    common.drop_written(spark)
    assert not folder.exists()
