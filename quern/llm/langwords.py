"""A word-list judge of languages for short texts, and the names of languages in labels and requests.

Each of the seven languages has the function words that tell it from the others and a few endings and letters. A word counts
for every language that has it, weighted by how few have it; the judge returns a language only where it leads clearly.
"""

import re
import unicodedata
from functools import lru_cache

#: Function words by language.
WORDS = {
    "es": "el la los las un una unos unas del al y o e u que qué quién cuál cuándo cómo dónde por para con sin sobre entre hasta desde hacia según durante mediante ante bajo contra tras es son era fue ser está están hay no sí ya más menos muy pero sino aunque porque pues como cuando donde si lo le les se su sus mi tu nos me te este esta estos estas ese esa eso esto aquel aquella cada todo todos toda todas otro otra otros otras mismo misma ha han había tiene tienen puede pueden debe deben también además después antes entonces así sin embargo ello ellos ellas dos tres cuatro cinco seis siete ocho nueve diez mientras dura año años día días",
    "en": "the a an of to in on at by for with without from into onto over under about after before between during until since against through and or but nor so yet if then than that this these those which who whom whose what when where why how is are was were be been being am has have had do does did will would can could shall should may might must not no yes it its he she they them their his her our your my we you i as all any each every some such only also more most less very there here however moreover because while although therefore afterwards",
    "fr": "le la les un une des du de au aux et ou où que qui quoi dont quand comment pourquoi par pour avec sans sur sous entre jusqu jusque depuis vers chez selon pendant avant après contre dans en est sont était être fut a ont avait avoir fait faire peut peuvent doit doivent ne pas non oui ni mais donc or car si lorsque puisque quoique il elle ils elles on nous vous je tu me te se lui leur leurs son sa ses mon ma mes ton ta tes notre votre ce cet cette ces celui celle ceux tout tous toute toutes chaque autre autres même plus moins très aussi ainsi alors ensuite cependant tant deux trois quatre cinq sept huit neuf dix à été aucun quelques",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber sondern denn doch dass daß ob wenn als wie wo wann warum was wer wen wem wessen welche welcher welches ist sind war waren sein wird werden wurde wurden hat haben hatte hatten kann können muss müssen soll sollen darf dürfen nicht kein keine keinen ja nein auch nur noch schon sehr mehr weniger so dann da hier dort er sie es wir ihr ich du ihn ihm uns euch sich mein dein unser euer dieser diese dieses diesen jeder jede jedes jedem alle allen in im an am auf aus bei mit nach von vom zu zum zur über unter vor hinter zwischen durch für gegen ohne um bis seit während wegen trotz laut gilt außerdem trotzdem später solange zwei drei vier fünf sechs sieben acht neun zehn",
    "pt": "o os a as um uma uns umas do da dos das no na nos nas ao aos à às pelo pela pelos pelas e ou que quê quem qual quando como onde porque por para com sem sobre entre até desde segundo durante conforme contra após é são era foi ser está estão há não sim já mais menos muito mas porém embora se lhe lhes seu sua seus suas meu minha este esta estes estas esse essa isso isto aquele aquela cada todo todos toda todas outro outra outros outras mesmo mesma tem têm pode podem deve devem também além disso depois antes então assim enquanto no entanto em de dois duas três quatro cinco seis sete oito nove dez ano anos",
    "it": "il lo la i gli le un uno una del dello della dei degli delle al allo alla ai agli alle dal dalla dai dalle nel nello nella nei negli nelle sul sulla sui sulle e ed o che chi cui quale quali quando come dove perché per con senza su tra fra fino da di a in secondo durante dopo prima contro è sono era fu essere sta stanno ha hanno aveva non sì già più meno molto ma però anche se lo gli loro suo sua suoi sue mio mia questo questa questi queste quello quella ogni tutto tutti tutta tutte altro altra altri altre stesso stessa può possono deve devono inoltre tuttavia poi allora così finché due tre quattro cinque sei sette otto nove dieci anno anni",
    "ca": "el els la les un una uns unes del dels al als i o que què qui quin quina quan com on per amb sense sobre entre fins des cap segons durant mentre contra després abans és són era fou ser està estan hi ha no sí ja més menys molt però sinó encara perquè doncs si ho li los se es seu seva seus seves meu meva nostre aquest aquesta aquests aquestes això aquell aquella cada tot tots tota totes altre altra altres mateix mateixa té tenen pot poden cal també a més així tanmateix obstant pel pels de en dos dues tres quatre cinc sis set vuit nou deu any anys aquí",
}
_LISTS = {lang: set(text.split()) for lang, text in WORDS.items()}
_WEIGHT = {w: 1.0 / sum(w in words for words in _LISTS.values()) for words in _LISTS.values() for w in words}
#: Endings and letters, each for the languages that have them.
_SHAPES = [
    (langs.split(), re.compile(shape))
    for langs, shape in (
        ("es", r"(?:ción|ciones|sión|dad|dades|aron|ieron|aje|ería|miento|mientos|dores)$|ñ|ll[aeo]s?$|ue.|ie[nrst]"),
        ("es pt it", r"[^aeiou]o$|ado$|ido$|[aei]o$"),
        ("es pt", r"(?:os|as|dor|ario)$"),
        ("es pt ca it", r"(?:a|ta|da|ncia)$"),
        ("en", r"(?:tion|ing|ness|ment|ly|ed|ght|ts|er|ies|ch|sh|ve)$|^th|^wh|w|sh|oo|ea"),
        ("fr", r"(?:tion|ement|eux|euse|eau|eaux|ée|ées|és|ent|ique|er|teur|oire|ues?|ges?|elle|otes?)$|[êœèûîù]|ou|ai|oi"),
        ("de", r"(?:ung|ungen|keit|heit|lich|lichen|ischen|schen|ten|gen|den|er|en|em|es|t|kt)$|ß|sch|ä|ck|ei|w|z"),
        ("pt", r"(?:ção|ções|são|ões|ão|ãe|dade|agem|inho|ível|veis|im|em|ais)$|[ãõ]|nh|lh|ei[rt]"),
        ("it", r"(?:zione|zioni|ità|aggio|ggio|zza|tti|tto|lla|lli|cchi|nno|gli|i|ore|are|ere|ire|ale|one)$|zz|gn|cch|ò|gg|cc|pp|tt"),
        ("ca", r"(?:ció|cions|sió|tat|tats|atge|eix|eixen|ns|nts|ts|ats|ents|ar|er|et|ent|at|ut|ix|ig|òria|ny|ll|ls|rs|cs|ms|ió|es|al|el)$|l·l|ny|ix|tx|ò|ï|ss|rr|tz"),
        ("es ca", r"^(?:re|in|des)|ci|qu[eio]|ment$"),
        ("fr pt ca", r"ç"),
    )
]
_ELISION = {"l": ("fr", "it", "ca"), "d": ("fr", "it", "ca"), "qu": ("fr",), "c": ("fr",), "n": ("fr", "ca"), "s": ("fr", "ca"), "m": ("fr", "ca"), "t": ("fr",), "j": ("fr",), "dell": ("it",), "all": ("it",), "nell": ("it",), "sull": ("it",), "un": ("it",), "jusqu": ("fr",)}
_TOKEN = re.compile(r"[^\W\d_]+(?:['’·][^\W\d_]+)*")
LANGUAGES = tuple(WORDS)

#: What labels and requests call the languages (folded; regions and scripts are cut off before).
NAMES = {
    "es": "es spa esp cas español espanol castellano castella spanish espagnol spagnolo espanhol castelhano spanisch espanyol castellà castilian castillan spanische",
    "en": "en eng ing inglés ingles english anglais inglese inglês englisch anglès angles englische",
    "fr": "fr fra fre francés frances french français francais francese francês französisch franzosisch francès französische",
    "de": "de deu ger ale alemán aleman german allemand tedesco alemão alemao deutsch alemany deutsche",
    "pt": "pt por portugués portugues portuguese portugais portoghese português portugiesisch portuguès portugiesische",
    "it": "it ita italiano italian italien italià italia italienisch italienische",
    "ca": "ca cat catalán catalan catalano catalão catalao katalanisch català catala valencià valenciano valencian katalanische",
}
BY_NAME = {name: lang for lang, names in NAMES.items() for name in names.split()}


def label_language(label: str | None) -> str | None:
    """The language that a label names by code, region or name; null if it names none of the seven.

    A label that names another language is its own folded text, so that it counts as a label, and a wrong one."""
    text = " ".join(unicodedata.normalize("NFKC", label or "").casefold().split()).strip(" .,;:()[]\"'")
    if text in BY_NAME:
        return BY_NAME[text]
    head = re.split(r"[-_@. /(]", text, maxsplit=1)[0]
    if head in BY_NAME and (len(head) <= 3 or head != text):
        return BY_NAME[head]
    return None


def word_scores(token: str) -> tuple[float, ...]:
    out = dict.fromkeys(LANGUAGES, 0.0)
    parts = token.split("'")
    for head in parts[:-1]:
        for lang in _ELISION.get(head, ()):
            out[lang] += 1.0 / len(_ELISION[head])
    word = parts[-1]
    if word == "s" and len(parts) > 1:
        out["en"] += 1.0
        return tuple(out.values())
    weight = _WEIGHT.get(word)
    if weight:
        for lang, words in _LISTS.items():
            if word in words:
                out[lang] += weight
    if len(word) > 3:
        for langs, shape in _SHAPES:
            if shape.search(word):
                for lang in langs:
                    out[lang] += 0.5 / len(langs)
    return tuple(out.values())


@lru_cache(maxsize=200_000)
def _token_scores(token: str) -> tuple[float, ...]:
    return word_scores(token)


def scores(text: str) -> dict[str, float]:
    found = [_token_scores(t) for t in _TOKEN.findall(text.lower().replace("’", "'"))]
    return dict(zip(LANGUAGES, map(sum, zip(*found)))) if found else dict.fromkeys(LANGUAGES, 0.0)


def judge(text: str, lead: float = 1.15, least: float = 1.0) -> str | None:
    """The language of a text, or null where none leads."""
    ranked = sorted(scores(text).items(), key=lambda x: -x[1])
    (lang, best), (_, second) = ranked[:2]
    return lang if best >= least and best >= lead * second else None


def requested(question: str) -> set[str]:
    """Languages that a question asks an answer in: a name of a language behind a preposition."""
    found = set()
    for m in re.finditer(r"(?i)\b(?:into|in|to|al|a|en|em|para|in|ins|auf|nach|vers|au|all)\s*(?:le\s|il\s|lo\s|l'|la\s|o\s|das\s)?\s*([^\W\d_]{4,})", question):
        lang = BY_NAME.get(m[1].lower())
        if lang:
            found.add(lang)
    return found
