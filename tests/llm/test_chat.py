"""Template language, reversible escapes, and formatted conversations against a plain reading."""

import hashlib
import random

import pytest

from tablewise.llm import chat, template

CONV = "conv_id long, turn long, role string, text string"


def plain(rows):
    """conv_id: (n_turns, turns digest, loss chars, loss digest)."""
    out = {}
    low = float("-inf")
    for conv, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), low if r[1] is None else r[1], r[2] or "", r[3] or "")):
        held = out.setdefault(conv, ["", 0, ""])
        held[0] += f"{role or ''}\n{text or ''}\n"
        held[1] += 1
        held[2] += (text or "") if role == "assistant" else ""
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return {c: (n, sha(t), len(loss), sha(loss)) for c, (t, n, loss) in out.items()}


def report(frame, **options):
    found = chat.conversation_report(frame, **options).collect()
    assert len({r.conv_id for r in found}) == len(found)
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found}, {r.conv_id: r.formatted_chars for r in found}


def odd_rows():
    rnd = random.Random(4)
    pieces = [*chat.CONTROLS, "\\", "|", "\\|", "<", "[", "]", "INST]", "/s>", " ", "\n", "é", "😀", "a", ""]
    said = lambda: "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 12)))
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "tool", "", None, said()]), rnd.choice([said(), said(), None])) for c in range(40) for t in range(rnd.randint(1, 9))]
    rows += [(None, 0, "user", "a"), (None, None, "assistant", "b"), (7, 1, "user", "same"), (7, 1, "user", "same"), (50, 0, "assistant", "x" * 2_500_000), (50, 1, "user", "y")]
    return rows


def test_report_equals_plain_reading(spark):
    rows = odd_rows()
    frame = spark.createDataFrame(rows, CONV).selectExpr("*", "1 as n_turns", "2 as whole", "3 as first_turn", "4 as mask")
    assert report(frame)[0] == plain(rows)


def test_long_conversations_are_rendered_in_parts(spark):
    rnd = random.Random(2)
    rows = [(1, t, rnd.choice(["user", "assistant", "system"]), f"turn {t} </s>") for t in range(3000)] + [(2, 0, "user", "a"), (2, 1, "assistant", "b")]
    rows += [(None, t, "assistant", str(t)) for t in range(500)]
    frame = spark.createDataFrame(rows, CONV)
    whole, sizes = report(frame)
    parts, sizes_of_parts = report(frame, long_turns=100)
    assert whole == parts == plain(rows) and sizes == sizes_of_parts
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # neighbours that meet in a task are rendered together
    try:
        formatted = chat.format_conversations(frame, long_turns=100).where("conv_id = 1").orderBy("first_turn").collect()
        assert report(frame, long_turns=100) == (whole, sizes)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(formatted) > 5 and formatted[0].text.startswith("<s>") and not any(r.text.startswith("<s>") for r in formatted[1:])


def test_control_conversation(spark):
    frame = chat.with_control_conversation(spark.createDataFrame([(3, 0, "user", "hi")], CONV))
    found, sizes = report(frame)
    text = "</s>[INST] ok [/INST]"
    assert found[-1] == (2, hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest(), len(text), hashlib.sha256(text.encode()).hexdigest())
    assert sizes == {3: 20, -1: 3 + 2 * (len(text) + 6) + 15 + 4}


def test_empty_table(spark):
    assert report(spark.createDataFrame([], CONV))[0] == {}


def test_escape_is_reversible():
    rnd = random.Random(1)
    for _ in range(3000):
        text = "".join(rnd.choice(["<", "/", "s", ">", "[", "INST]", "</s>", "[INST]", "\\", "|"]) for _ in range(rnd.randint(0, 10)))
        assert chat.unescape(chat.escape(text)) == text and not chat._CONTROL.search(chat.escape(text))


def test_template_language():
    source = "{% set n = 'x' ~ 1 + 2 %}{# note #}[{% for m in messages %}{{ loop.index }}:{{ m.role | upper if m.role != 'u' else m['text'] | default('-') | trim }}{% if not loop.last and loop.index0 < 5 %}, {% endif %}{% endfor %}]{{ n }}{{ 7 % 4 - 1 }}"
    made = template.Template(source)
    text, spans = made.render([{"role": "u", "text": " a "}, {"role": "sys"}, {"role": "u"}])
    assert text == "[1:a, 2:SYS, 3:-]x32" and spans == []


def test_constants_are_folded():
    made = template.Template("{% if mode == 'a' and 1 < 2 %}A{{ 'b' | upper }}{% else %}{{ unknown }}{% endif %}{% for m in messages %}{% if mode == 'z' %}no{% endif %}{{ m.text }}{% endfor %}", {"mode": "a"})
    assert made.tree[0] == template.Text("AB") and len(made.tree) == 2 and len(made.tree[1].body) == 1


def test_marks_are_in_code_points():
    made = template.Template("é{% for m in messages %}{% generation %}{{ m.text }}!{% endgeneration %}.{% endfor %}")
    text, spans = made.render([{"text": "😀a"}, {"text": ""}])
    assert text == "é😀a!.!." and [text[a:b] for a, b in spans] == ["😀a!", "!"]


@pytest.mark.parametrize("source", [
    "no loop", "{% for a in messages %}{% for b in messages %}{% endfor %}{% endfor %}", "{% for a in messages %}", "{{ a.b() }}{% for a in messages %}{% endfor %}",
    "{% for m in messages %}{{ m | nothing }}{% endfor %}", "{{ 'a' * 9 }}{% for a in messages %}{% endfor %}", "{% set loop = 1 %}{% for a in messages %}{% endfor %}",
    "{% for m in messages %}{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}{% endfor %}", "{% include 'x' %}{% for a in messages %}{% endfor %}",
    "{{ 'a' + 1 }}{% for a in messages %}{% endfor %}", "{{ 1 %}{% for a in messages %}{% endfor %}",
])
def test_refused_templates(source):
    with pytest.raises(template.TemplateError):
        template.Template(source)


@pytest.mark.parametrize("inside", ["m.text.__class__", "m.__class__.__mro__", "messages", "m.text.upper", "open", "m"])
def test_nothing_outside_is_reached(inside):
    made = template.Template("{% for m in messages %}{{ " + inside + " }}{% endfor %}")
    try:
        assert made.render([{"text": "a"}])[0] == ""  # a key that isn't there
    except template.TemplateError:
        pass
