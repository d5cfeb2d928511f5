"""The search grammar: terms, quoted phrases, - exclusions and OR branches.  Runs on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import regex

#: Fixed values of the grammar.
MOST_CHARACTERS = 200
_TOKEN = regex.compile(r'(?P<blank>\s+)|(?P<minus>-)|"(?P<phrase>[^"]*)"|(?P<open>")|(?P<term>[\p{L}\p{N}_]+)|(?P<other>.)', regex.S)
_LEXEME = regex.compile(r"[\p{L}\p{M}\p{Nd}]+")


class QueryError(ValueError):
    """The text is not a valid search query."""


@dataclass(frozen=True)
class Operand:
    value: str
    phrase: bool = False
    excluded: bool = False
    prefix: bool = False

    @property
    def lexemes(self) -> list[str]:
        return _LEXEME.findall(self.value.lower())


def parse(text: str) -> list[list[Operand]]:
    """Branches (any may match) of operands (all must match).

    The last positive unquoted term of a branch is a prefix.  Raises :class:`QueryError` for empty or
    too long text, an open quote, a lone -, a branch without a positive operand, or an operand without
    a letter or digit.
    """
    text = text.strip()
    if not 1 <= len(text) <= MOST_CHARACTERS:
        raise QueryError(text)
    branches: list[list[Operand]] = [[]]
    fresh, excluded = True, False  # at the start of an operand; after a - that excludes it
    found = list(_TOKEN.finditer(text))
    for token, after in zip(found, [*found[1:], None], strict=True):
        kind = token.lastgroup
        if kind == "open":
            raise QueryError(text)
        if kind == "minus" and fresh and not excluded:
            if after is None or after.lastgroup == "blank":
                raise QueryError(text)
            excluded = after.lastgroup in ("phrase", "open", "term")
        elif kind == "term" and fresh and not excluded and token[0].lower() == "or":
            if not branches[-1]:
                raise QueryError(text)
            branches.append([])
        elif kind in ("term", "phrase"):
            operand = Operand(token[kind].strip() if kind == "phrase" else token[kind], kind == "phrase", excluded)
            if not operand.lexemes:
                raise QueryError(text)
            branches[-1].append(operand)
            fresh, excluded = False, False
        else:
            fresh = True
    return [_finished(branch, text) for branch in branches]


def _finished(branch: list[Operand], text: str) -> list[Operand]:
    if all(o.excluded for o in branch):
        raise QueryError(text)
    terms = [i for i, o in enumerate(branch) if not o.excluded and not o.phrase]
    if not terms:
        return branch
    last = terms[-1]
    if len(branch[last].lexemes) != 1:
        raise QueryError(text)
    return [Operand(o.value, o.phrase, o.excluded, i == last) for i, o in enumerate(branch)]
