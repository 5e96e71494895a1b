"""Fixed word lists of the six languages, and tokens."""

from __future__ import annotations

import re

#: Frequent function words.
FUNCTION_WORDS = {
    "en": "the a an of to and in that is was for it on with as at by from this be are or not but have has had which they we you our my their can so if when while after before any all no will would should only there one two what how why".split(),
    "de": "der die das den dem des ein eine einen einem einer und in zu von mit auf für ist im am nicht dass es sich auch an als bei nach aus wie wenn aber oder wir sie ich er hat wird wurde werden zum zur noch nur bis wo was über unter vor ihre unsere seit unsere".split(),
    "fr": "le la les un une des du de et à en que qui pour dans sur est au aux ne pas par plus ce cette se il elle nous vous on avec son sa ses ou mais comme quand si leur sans sous ont été après avant même notre d l c n j".split(),
    "es": "el la los las un una unos de del y a en que por para con se es al lo su sus no como más pero o si cuando nos fue ha este esta entre sin sobre después antes hasta nuestra nuestro muy ya qué cómo le aunque".split(),
    "pt": "o a os as um uma de do da dos das e em no na nos nas que por para com se é ao à seu sua não como mais mas ou quando foi até este esta entre sem sobre depois antes nossa nosso pelo pela muito já num numa foi cada".split(),
    "ru": "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня о из ему теперь когда для это этот мы они или если под при чтобы без до после перед наш который пока кто прежде чем именно этого этой всех наших наша наше несколько один одна одно весь всё также уже ещё тем том даже между через после перед очень только каждый каждую каждая там тут нас вас их её ему со об обо ли же самый самую самая который которая которые нет есть будет может".split(),
}
FUNCTION_WORD_SET = frozenset(w for words in FUNCTION_WORDS.values() for w in words)

#: Spellings of language labels (tags, three-letter codes, own and foreign names).
LANGUAGE_NAMES = {
    "en": "en eng english englisch anglais inglés ingles inglês английский".split(),
    "de": "de deu ger german deutsch allemand alemán aleman alemão alemao немецкий".split(),
    "fr": "fr fra fre french französisch franzoesisch français francais francés frances francês французский".split(),
    "es": "es spa spanish spanisch espagnol español espanol castellano espanhol испанский".split(),
    "pt": "pt por portuguese portugiesisch portugais portugués portugues português португальский".split(),
    "ru": "ru rus russian russisch russe ruso russo русский".split(),
}
LANGUAGE_OF_NAME = {name: code for code, names in LANGUAGE_NAMES.items() for name in names}

WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


def language_of_label(label: str | None) -> str | None:
    """The language a label names, or None where it names none of the six."""
    if not label:
        return None
    text = label.strip().lower()
    if text in LANGUAGE_OF_NAME:
        return LANGUAGE_OF_NAME[text]
    head = re.split(r"[-_ (/;,.]", text, maxsplit=1)[0]
    return LANGUAGE_OF_NAME.get(head)
