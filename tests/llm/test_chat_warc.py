"""Templates, chat formatting and the archive."""

import base64
import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from parity import compare, connect

import __spark_entry__ as entry
from portlake.llm import chat, warc
from portlake.llm.template import Const, Emit, Template, TemplateError, hide, hide_line, parse, show, show_line

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_chat_formatting", "op2_warc"])
def test_matches_sql(spark, name):
    assert compare(entry.queries()[name](spark, SMALL), connect(SMALL), entry.oracle_sql()[name]) is None


def render(source, *messages):
    return Template(source).render([{"role": r, "text": t} for r, t in messages])


def test_language():
    two = (("user", "a"), ("assistant", "b"))
    assert render("{% for m in messages %}{{ loop.index }}{{ m['role']|upper }}{{ '' if loop.last else ',' }}{% endfor %}", *two)[0] == "1USER,2ASSISTANT"
    assert render("{{ messages|length }}{{ messages[0].text }}{{ messages[9].text }}", *two)[0] == "2a"
    assert render("{% set x = 1 + 2 * 3 %}{{ x }}{# no #}{{ 'a' in 'cat' and not false }}", *two)[0] == "7true"
    assert render("{% if messages[0].role == 'system' %}s{% elif 1 > 2 %}n{% else %}e{% endif %}", *two)[0] == "e"
    assert render("x{% for m in messages %}{% generation %}{{ m.text }}{% endgeneration %}-{% endfor %}", *two) == ("xa-b-", [(1, 2), (3, 4)])


def test_constants_are_folded():
    assert Template("a{{ 'b' ~ 1 + 1 }}{% if false %}no{% else %}c{% endif %}{{ 'D'|lower }}").tree == [Emit(Const("ab2cd"))]
    assert Template("{% for m in messages %}{{ '<' ~ m.text ~ '>' ~ '!' }}{% endfor %}").tree[0].body[2] == Emit(Const(">!"))


@pytest.mark.parametrize("source", ["{% for x %}", "{% if a %}", "{{ a.b. }}", "{{ a|nothing }}", "{{ f(1) }}", "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}", "{{ 'a }}"])
def test_wrong_templates(source):
    with pytest.raises(TemplateError):
        parse(source)


def test_sandbox():
    assert render("{{ messages.__class__ }}{{ messages[0].__init__ }}{{ 'a'.__class__ }}", ("user", "a"))[0] == ""


def test_streaming_is_the_same():
    rows = [{"role": "assistant" if k % 2 else "user", "text": f"t{k}<|im_end|>"} for k in range(50)]
    model = Template(chat.TURNS)
    assert model.streams
    chunks = list(model.stream(iter(rows), limit=100))
    assert len(chunks) > 5 and "".join(c for c, _ in chunks) == model.render(rows)[0]


@given(st.text(st.sampled_from(list("<|\\>\nim_end a"))))
def test_escapes_come_back(text):
    assert show(hide(text)) == text and "<|" not in hide(text)
    assert show_line(hide_line(text)) == text and "\n" not in hide_line(text)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "<|im_start|>"]), st.text(st.sampled_from(list("<|\\>\nab")))), max_size=5))
def test_turns_come_back(turns):
    text, _ = render(chat.TURNS, *turns)
    assert list(chat.turns_in(text)) == turns


def test_awkward_conversations(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (1, 1, "assistant", "w"), (None, 0, None, "n"), (2, None, "assistant", ""), (3, 0, "assistant", "<|im_end|>" * 3)]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, chunk int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns, limit=5)).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == digest("user\n\nassistant\nw\nassistant\nx\nassistant\nx\n") and got[1].loss_sha256 == digest("wxx") and got[1].loss_chars == 3
    assert got[None].n_turns == 1 and got[2].loss_chars == 0 and got[3].loss_sha256 == digest("<|im_end|>" * 3)
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0


def test_awkward_pages(spark):
    rows = [(3, "http://a/\r\nX: y", "same"), (1, None, "same"), (1, "u", "same"), (2, "u", None), (4, "u", ""), (None, "u", "same"), (None, "u", "only"), (9, "u", "é" * 50_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    records = warc.read_archive(spark, warc.write_archive(pages))
    got = sorted(warc.describe(records).collect(), key=lambda r: (r.page_id is None, r.page_id or 0, r.payload_bytes))
    want = base64.b32encode(hashlib.sha1(b"same").digest()).decode()
    assert [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got] == [
        (1, 4, "response", None), (1, 4, "response", None), (2, 0, "response", None), (3, 4, "revisit", 1), (4, 0, "revisit", 2), (9, 100_000, "response", None),
        (None, 4, "revisit", 1), (None, 4, "response", None)]
    assert got[0].payload_digest == want
    third = [bytes(r.record) for r in records.where("page_id = 3").collect()][0]
    assert third.count(b"\r\n\r\n") == 2 and b"http://a/%0D%0AX: y" in third and b"Content-Length: 0" in third
    assert warc.read_archive(spark, warc.write_archive(pages.limit(0))).count() == 0
    small = warc.describe(warc.read_archive(spark, warc.write_archive(pages, min_bytes=1))).where("page_id = 4").first()
    assert small.record_type == "response"


def test_hot_payload_is_salted(spark):
    pages = spark.range(9000).selectExpr("id AS page_id", "'u' AS url", "if(id % 3 = 0, 'hot', cast(id as string)) AS html")
    got = warc.describe(warc.read_archive(spark, warc.write_archive(pages)))
    assert got.count() == 9000 and got.where("record_type = 'revisit' AND refers_to = 0").count() == 2999
