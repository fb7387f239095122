"""The licence prefilter against every rule, on strings made from the rules' own expressions."""

import itertools
from re import _constants as C
from re import _parser as P

import pyarrow as pa
import pytest
from test_rowwise_operators import word_list

from leafspark.llm import licenses


def strings(items):
    """Every choice of alternatives, with each optional part in and out; one letter of each class."""
    parts = []
    for op, arg in items:
        if op is C.LITERAL:
            parts.append([chr(arg)])
        elif op is C.IN:
            parts.append([chr(arg[0][1] if arg[0][0] is C.LITERAL else arg[0][1][0])])
        elif op is C.SUBPATTERN:
            parts.append(strings(arg[3]))
        elif op is C.BRANCH:
            parts.append([s for alternative in arg[1] for s in strings(alternative)])
        else:
            assert op is C.MAX_REPEAT
            least, _, one = arg
            parts.append(["".join(s) for k in ([0, 1] if least == 0 else [least]) for s in itertools.product(strings(one), repeat=k)])
    return ["".join(s) for s in itertools.product(*parts)]


def test_every_alternative_has_a_keyword():
    """Names, identifiers and notices; frames 1 and 2 only put words before the names of frame 3."""
    seen = 0
    for rule in licenses.rules():
        if rule.priority in (1, 2):
            continue
        for s in strings(P.parse(rule.expression.replace(" ?", "(?: )?"))):
            assert rule.find.search(s), (s, rule)
            assert set(rule.keywords) & set(word_list(s)), (s, rule)
            seen += 1
    assert seen > 1000


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("No part of this book may be reproduced.", "permission-reserved"),
        ("Under the Q Public License", "qpl-1.0"),
        ("QPublic licence", "qpl-1.0"),
        ("see CeCILL2.1", "cecill-2.1"),
        ("Simplified BS licence", "bsd-2-clause"),
    ],
)
def test_found_without_the_usual_word(text, label):
    found = licenses._work([text.encode()])
    assert pa.array(found[5]).to_pylist() == [label]


def test_names_found_wanting():
    for text, label in (("the FreeBSD license applies", "bsd-2-clause"), ("Simplified BSD licence", "bsd-2-clause"), ("GNU AGPL", "agpl"), ("Q Public License", "qpl-1.0"), ("GNU GPL", "gpl-any")):
        assert label in pa.array(licenses._work([text.encode()])[5]).to_pylist()[0].split(","), text
