"""Charts of JavaScript, TypeScript, Java and C by their edges between labels."""

import pytest

from tessera.functions.braces import brace_charts, condition_in_words, statement_in_words

C = """#include <stdio.h>
int count(int from, char *word) {
    int i, sum = 0;
    for (i = from; i < 9; i++) {
        if (i == 4) continue;
        sum += i;
    }
    do {
        sum--;
        if (sum == 5) continue;
    } while (sum > 3);
    switch (sum) {
    case 1:
    case 2: one(); break;
    case 3: three();
    default: rest();
    }
    while (1) { if (sum) break; step(); }
    return sum;
    never();
}
"""
JAVA = """class Shop {
  int sell(final Order order, int n) throws Gone {
    for (Item item : order.items) { System.out.println(item); }
    switch (n) { case 1, 2 -> few(); default -> { many(); } }
    try (Reader r = open()) { risky(); } catch (Bad e) { throw new Gone(e); } finally { close(); }
    if (n > 1) { return 1; } else if (n < 0) { n++; } else n = 2;
    return n;
  }
}
"""
SCRIPT = """function walk(keys, deep = true) {
  for (const key of keys) use(key)
  let total = 0
  outer: while (total < 3) {
    total += 1
    if (total === 2) { break }
  }
  try { risky() } catch { mend() }
  return total
}
const next = (a) => a + 1;
"""
TYPED = "export function down(n: number, log?: string): number {\n  while (n > 0) { n--; }\n  return n;\n}\n"


def edges(text, language, name):
    c = dict(brace_charts(text, language))[name]
    label = {b["n"]: b["label"] for b in c.boxes}
    return {(label[e["source"]], e["label"], label[e["target"]]) for e in c.edges}, c


def test_c():
    e, c = edges(C, "c", "count")
    assert c.boxes[0]["label"] == "start: count(from, word)" and not any("never" in b["label"] for b in c.boxes)
    assert {
        ("int i, sum = 0;", "", "i = from"), ("i = from", "", "i < 9?"), ("i < 9?", "yes", "i == 4?"), ("i == 4?", "yes", "i++"), ("sum += i;", "", "i++"), ("i++", "", "i < 9?"),
        ("i < 9?", "no", "sum--;"), ("sum == 5?", "yes", "sum > 3?"), ("sum > 3?", "yes", "sum--;"), ("sum > 3?", "no", "which sum?"), ("which sum?", "1, 2", "one();"),
        ("which sum?", "3", "three();"), ("three();", "", "rest();"), ("which sum?", "default", "rest();"), ("one();", "", "repeat forever"), ("sum?", "yes", "return sum;"), ("step();", "", "repeat forever"),
    } <= e
    assert ("which sum?", "other", "repeat forever") not in e and c.boxes[0]["first"] == 2 and c.boxes[-1]["last"] == 21


def test_java():
    e, c = edges(JAVA, "java", "Shop.sell")
    assert c.boxes[0]["label"] == "start: sell(order, n)"
    assert {
        ("next item in order.items?", "yes", "System.out.println(item);"), ("next item in order.items?", "no more", "which n?"), ("which n?", "1, 2", "few();"), ("few();", "", "try"), ("many();", "", "try"),
        ("try", "if error", "throw new Gone(e);"), ("throw new Gone(e);", "error", "end"), ("risky();", "", "close();"), ("close();", "", "n > 1?"), ("n > 1?", "no", "n < 0?"), ("n < 0?", "yes", "n++;"), ("n < 0?", "no", "n = 2;"), ("n = 2;", "", "return n;"),
    } <= e


def test_scripts():
    e, c = edges(SCRIPT, "javascript", "walk")
    assert c.boxes[0]["label"] == "start: walk(keys, deep)"
    assert {("next key in keys?", "yes", "use(key)"), ("next key in keys?", "no more", "let total = 0"), ("total < 3?", "yes", "total += 1"), ("total === 2?", "yes", "try"), ("try", "if error", "mend()"), ("mend()", "", "return total"), ("return total", "", "end")} <= e
    _, c = edges(SCRIPT, "javascript", "next")
    assert [b["kind"] for b in c.boxes] == ["start", "return", "end"] and c.boxes[1]["label"] == "return a + 1"
    e, c = edges(TYPED, "typescript", "down")
    assert {("n > 0?", "yes", "n--;"), ("n--;", "", "n > 0?"), ("n > 0?", "no", "return n;")} <= e and c.boxes[0]["label"] == "start: down(n, log)"


@pytest.mark.parametrize("language", ["c", "java", "javascript", "typescript"])
def test_broken_text_and_budget(language):
    for text in (C, JAVA, SCRIPT, TYPED):
        for cut in range(0, len(text), 7):
            list(brace_charts(text[:cut], language))
            list(brace_charts(text[cut:], language))
    if language != "java":
        head = "int f(int a) {" if language == "c" else "function f(a) {"
        ((_, c),) = brace_charts(head + "".join(f"if (a == {i}) {{ g({i}); }}\n" for i in range(100)) + "}", language)
        assert len(c.boxes) <= 72 and any(b["kind"] == "folded" for b in c.boxes)


def test_words():
    assert condition_in_words("a >= 1 && !done") == "a is at least 1 and not done"
    assert [statement_in_words(x) for x in ("i++;", "x -= 2", "int n = f(1);", "printf(\"%d\", n);", "run(a, b)", "goto out")] == ["Add 1 to i.", "Take 2 from x.", "Set n to f(1).", 'Show "%d", n.', "Run run() with a, b.", "Do: goto out"]


def test_too_deep():
    assert list(brace_charts("int f(int a) {" + "if (a) {" * 5000 + "}" * 5001, "c")) == []
