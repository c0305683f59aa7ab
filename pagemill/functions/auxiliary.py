"""Auxiliary verbs: the pattern of a stem ("hae bo": a head ending, and a tail) and which of its matches are something else."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Heads that are nouns with a verb's ending, and heads that are adnominal or adverbs.
NOUN_HEADS = ("이야기해", "사랑해", "미워해")
FALSE_HEADS = ("대해", "관해", "위해", "오해", "통해", "비해", "관련해", "이해", "상해")
# What a tail of one syllable does not go on with, as then it begins a noun or another verb.
NOT_AFTER = {
    "하": ("루", "하", "히", "허", "할", "함", "합", "핫"),
    "주": ("택", "민", "식", "문", "장", "의", "재", "권", "년", "일", "번", "소"),
    "지": ("급", "역", "금", "구", "도", "원", "적", "시", "명", "점", "체", "속", "식", "연", "출"),
    "보": ("상", "통", "율", "안", "류", "수", "호", "증", "장", "험", "관", "고서"),
}
# Particles between an object and the connective ending, at a head's end, and after dependent nouns; phrases that take no glued auxiliary.
OBJECT_PARTICLES = ("을", "를", "에", "도", "만", "와", "과", "로", "으로", "부터", "까지", "한테", "에게", "께", "에서")
HEAD_PARTICLES = ("도", "는", "만", "을", "를", "에", "와", "과", "로", "으로", "부터", "까지", "밖에", "조차", "마저", "라도", "이라도", "에게", "한테", "께", "께서")
NOUN_PARTICLES = ("체를", "듯도", "듯이", "만은", "만도", "것을", "줄을", "줄은", "듯을", "체는", "체가")
BOUND_PHRASES = ("싶어", "들어", "않아", "않으", "키지", "되지", "싶지", "말고")
NOT_BEHIND = ("으로",)


@dataclass(frozen=True)
class Auxiliary:
    """A stem of two parts, and the lists that decide about its matches; ``allowed`` are beginnings of heads that may be long."""

    head: str
    tail: str
    allowed: tuple[str, ...] = ()
    letters: str = "가-힣"
    longest: int = 2
    hae: str = "해"
    noun_heads: tuple[str, ...] = NOUN_HEADS
    false_heads: tuple[str, ...] = FALSE_HEADS
    hada: str = "하"

    def pattern(self) -> str:
        """Group 1 is the head as it stands, with all before its ending; any blanks but line ends; group 2 the tail with what goes on."""
        after = "|".join(map(re.escape, NOT_AFTER.get(self.tail, ())))
        behind = "|".join(map(re.escape, NOT_BEHIND))
        return rf"(\S*{re.escape(self.head)})[^\S\n]+({re.escape(self.tail)}{f'(?!{after})' if after else ''}[{self.letters}]*)(?!{behind})"

    def too_long(self, head: str) -> bool:
        """Whether a head has more letters than a verb to which auxiliaries are checked; before "hae", an object with its particle does not count."""
        own = head
        if self.head == self.hae and head.endswith(self.hae) and head[: -len(self.hae)].endswith(OBJECT_PARTICLES):
            own = self.hae
        return len(re.findall(f"[{self.letters}]", own)) > self.longest

    def is_allowed(self, head: str) -> bool:
        """Whether a head, or what stands before its ending, begins with an allowed verb, with or without its dictionary ending."""
        if head in self.noun_heads:
            return False
        portion = head[: -len(self.head)].strip() if self.head and head.endswith(self.head) else head
        begins = [a.strip() for a in self.allowed if a.strip()]
        begins += [a[:-1] for a in begins if a.endswith("다") and len(a) > 1]
        return any(head.startswith(a) or portion.startswith(a) for a in begins)

    def is_other(self, head: str | None, glued: bool) -> bool:
        """Whether a match is no auxiliary: a noun, a head too long, an adnominal, or, written as one word, a head with a particle or a bound phrase."""
        head = (head or "").strip()
        if not head:
            return False
        if head in self.noun_heads or (self.too_long(head) and not self.is_allowed(head)):
            return True
        if self.head == self.hae and ((len(head) == 2 and head.endswith(self.hae)) or head in self.false_heads):
            return True
        bound = self.tail == self.hada and self.head in ("어", "아") and head.endswith(BOUND_PHRASES)
        return glued and (head.endswith(HEAD_PARTICLES) or head.endswith(NOUN_PARTICLES) or bound)
