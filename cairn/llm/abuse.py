"""Problem 8: abusive, hateful or sexual content.

Method: gradient-boosted trees over dense features - densities of lexicon classes, distance of the second person to harsh
words, capitals, punctuation, obfuscated spelling - with isotonic calibration.  The features of a text are those of its
worst clause, besides its own rates.  There are two lexicons: a general one, fixed below, and one that is learned from the
labelled texts, of phrases of one to three words, each with how far its texts' share of toxic labels is above chance.  For training, the weights of a
text's phrases come from the other folds' texts only, so the trees see them as they are on texts that nobody has labelled.

Training: on the labelled texts (at most ``max_labelled`` of them, chosen by hash; raters' labels of one text are averaged)
and on the few fixed examples below, which keep the model sound where labels are few.  Everything else covers all rows.

Scale: two narrow passes over the texts (one that picks the labelled ones, which are written once, and one that scores all);
phrases are counted by an aggregate over the labelled sample, the model is bounded by ``max_phrases``; no text is shuffled.

Defined results: null or empty text - the score of a text without any sign; rows of one doc_id are scored one by one and
the highest score counts; a null source is the source "" in the rates; without any labels the fixed examples alone train.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.boosting import Boosted
from cairn.operators.lineage import cut

#: The lexicon by class; phrases are matched on folded text (lower case, no accents, one space).
LEXICON = {
    "insult": """idiot moron imbecile imbecil cretin bastard scumbag scum asshole arsehole dumbass jackass loser clown parasite dipshit dickhead retard retarded degenerate bellend tosser knobhead
        slut whore skank thot bitch cunt twat wanker prick douchebag douche fuckwit fuckface fucktard motherfucker shithead shitbag pillock nitwit dimwit halfwit numbskull knucklehead dunce creep lowlife dirtbag sleazebag
        piece of shit|son of a bitch|sack of shit|bag of shit|piece of garbage|piece of trash|waste of space|village idiot
        arschloch trottel schwachkopf drecksack vollidiot dummkopf hurensohn wichser mistkerl depp deppen penner spast spasti versager miststuck schlampe fotze nutte hure huren dreckskerl drecksau schweinehund schwein bloedmann idioten missgeburt abschaum
        connard connasse abruti abrutis debile salaud salope encule batard ordure crevure pute putes putain pouffiasse raclure ducon imbeciles minable
        pauvre type|fils de pute|sale con|gros con|pauvre con|petit con|sombre merde|tas de merde|sac a merde
        cabron cabrona payaso gilipollas idiota estupido pendejo capullo subnormal tarado cretino puta zorra guarra malparido desgraciado escoria gentuza mamon hijoputa huevon boludo
        hijo de puta|pedazo de mierda|cara de mierda""",
    "slur": """nigger nigga kike wetback chink gook paki raghead towelhead beaner faggot fag tranny shemale dyke homo spic coon golliwog sandnigger
        jungle bunny|camel jockey|carpet muncher
        kanake kanaken kanacke neger schwuchtel tunte judensau polacke kameltreiber schlitzauge zigeunerpack tucke kampflesbe
        bougnoule bicot youpin negre pede tapette gouine tarlouze tafiole bamboula niakoue
        sale arabe|sale juif|sale noir|sale gouine|sale pede
        sudaca maricon marica bollera panchito tortillera mariposon
        negro de mierda|moro de mierda|judio de mierda|gitano de mierda""",
    "harsh": """pathetic worthless brainless braindead filthy disgusting stupid dumbest dumb damn damned goddamn fucking fuckin bloody useless lying trash garbage revolting despicable repulsive vile ugly hate sickening shitty crappy
        shut the|so dumb|so stupid|i hate you|hate you|fuck you
        hirnlos hirnlose hirnloser dumm dumme dummer dreckig dreckige dreckiger erbarmlich erbarmlicher nutzlos nutzloser widerlich widerliche widerlicher ekelhaft ekelhafte verdammt verdammter scheiss scheisse bescheuert
        ich hasse dich|ich hasse euch
        miserable degoutant stupide sale pitoyable lamentable
        espece de|pauvre|je te hais|je vous hais|je te deteste
        maldito maldita asqueroso asquerosa estupida inutil sucio sucia patetico
        pedazo de|te odio|os odio|mierda""",
    "dismiss": """shut up|get lost|fuck off|piss off|go to hell|screw you|fuck you|bugger off|go away|sod off|get out of here|nobody likes you|nobody wants you|go fuck yourself|up yours|eat shit|bite me|shut your mouth
        halt die klappe|halt's maul|halts maul|halt die fresse|verpiss dich|hau ab|fick dich|leck mich|zieh leine|geh sterben
        ferme-la|ferme la|ta gueule|degage|casse-toi|casse toi|va te faire|nique ta mere|va chier|fous le camp|je t'emmerde
        callate|largate|vete a la|que te den|que te jodan|vete al|jodete|chinga tu madre|cierra el pico|andate a la""",
    "threat": """kill you|beat you|hurt you|hunt you|find you and|smash your|break your|punch you|stab you|shoot you|strangle you|rape you|slit your throat|cut your throat|burn your house|where you live|come for you|make you pay|make you suffer|you will pay for|you are dead|you're dead|watch your back|deserves a beating|should be beaten|should be shot|should be hanged|deserves to die|deserve to die|deserves a slap|beat him up|beat her up|teach you a lesson|teach him a lesson|teach her a lesson|teach them a lesson|beat the shit|kick your|wring your neck|choke you
        ich bring dich um|bring dich um|weiss wo du wohnst|auf die fresse|schlag dich|ich mach dich fertig|mach dich kalt|ich finde dich|knall dich ab|gehort verprugelt|stech dich ab|brech dir
        je vais te|sais ou tu|casser la gueule|te frapper|te tuer|te crever|te retrouver|merite une raclee|te saigner|tu vas le payer|tu es mort
        te voy a|se donde vives|romperte|partirte la cara|una paliza|te matare|voy a matarte|te rompo|vas a pagar|te arrepentiras|cortarte el cuello""",
    "wish": """kill yourself|kys|hope you die|go die|drop dead|die in a fire|end yourself|hang yourself|shoot yourself|should die|wish you were dead|better off dead|better off without you|waste of oxygen|would miss you|rot in hell|burn in hell|get cancer|jump off a|do us all a favour|do us all a favor|do the world a favour|do the world a favor|end your life|nobody would miss|slit your wrists
        bring dich doch um|hang dich auf|erschiess dich|verrecke|hoffentlich stirbst|stirb endlich|niemand wurde dich vermissen|ohne dich besser|fahr zur holle|nie geboren
        creve|va crever|va mourir|tue-toi|suicide-toi|pends-toi|personne ne te regretterait|tu ne manquerais|bruler en enfer|mieux sans toi
        muerete|ojala te mueras|ojala mueras|suicidate|matate|pegate un tiro|ahorcate|nadie te echaria|pudrete|mejor sin ti""",
    "demean": """vermin subhuman subhumans savages cockroaches untermensch
        inferior race|master race|back to your country|go back to where|back where they came from|your kind|scum of the earth|deport them|send them back|exterminate them|gas them|throw them out|kick them out|do not belong here|don't belong here|are animals|are all criminals|are all thieves|are all terrorists|are rats|are a disease|are a plague|cannot be trusted|can not be trusted|belong in the kitchen|belongs in the kitchen|ethnic cleansing|white power|heil hitler
        ungeziefer|untermenschen|dieses pack|auslander raus|raus aus unserem land|gehoren abgeschoben|gehoren vergast|minderwertig|minderwertige|sieg heil|schmarotzer|sind alle kriminelle|gehoren an den herd
        vermine|sous-hommes|sous-homme|sale race|race inferieure|dehors les|rentrez chez vous|rentre dans ton pays|retourne dans ton pays|tous des voleurs|sont des animaux|sont des rats
        ratas|sabandijas|raza inferior|hay que echarlos|echarlos a todos|vuelve a tu pais|vete a tu pais|fuera de aqui|son animales|son todos ladrones|infrahumanos|plaga""",
    "sexual": """porn|porno|nudes|horny|dick pic|dick pics|talk dirty|nice ass|nice tits|sexy ass|tits|boobs|pussy|cock sucker|cocksucker|blowjob|blow job|handjob|masturbate|masturbating|orgasm|cum shot|cumshot|fuck me|fuck her|suck my|explicit sex|had sex|have sex|sex videos|sex video|hot singles|see you naked|get naked|naked pictures|naked photos|her breasts|his cock|threesome|gangbang|xxx|camgirl|upskirt|strip for me|erotic|sex chat|webcam sex
        nacktbilder|nacktfotos|pornofilme|sexfilme|sexvideos|titten|ficken|gefickt|muschi|blasen dich|sexchat|schwanz lutschen|nackt sehen|zieh dich aus|geile
        toi nue|toute nue|nue sur|photos nues|sexe gratuit|videos porno|baiser|baise|seins nus|suce|chatte|envie de toi|film porno|plan cul
        desnuda|desnudas|desnudate|fotos desnuda|sexo gratis|sexo sin|videos porno|follar|follarte|tetas|polla|chupame|cachonda|cachondo|peliculas porno""",
    "neutral": """process|processes|prozess|processus|proceso|child process|parent|thread|daemon|zombie|zombi|orphan|orphans|column|nullable|field|champ|campo|filter|filters|blacklist|blacklisted|whitelist|moderation|moderator|report|reported|policy|guideline|code of conduct|quoted|quote|documentation|example|word list|wordlist
        proof|by default|brute force|penetration test|out of memory|master|slave|dummy|terminal|binary|execute|dump|queue|cache|server|signal|abort|terminate|killer|simple|algorithm|pointer|pass|test|tests|build|parser|token|branch|config|column|database|table|module|function|class|variable
        server|dienst|datei|klasse|funktion|tests|fichier|serveur|fonction|classe|archivo|servidor|funcion|clase|tuer le|matar el|toten|puede|peut""",
    "group": """all|every one|those|people from|foreigners|immigrants|refugees|women|muslims|jews|blacks|gays|migrants|asians|gypsies|alle|auslander|fluchtlinge|migranten|frauen|muslime|juden|zigeuner|den|les|etrangers|immigres|femmes|arabes|juifs|musulmans|refugies|todos|los|extranjeros|inmigrantes|mujeres|musulmanes|judios|gitanos|diese""",
}
#: The second person.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch tu te toi ton ta tes vous eres tu ti te usted tus vosotros".split())
THIRD = frozenset("he she him her the this so ce cet cette el la der die maintainer author reviewer tester manager person team autor dem".split())
#: Letters of other scripts and digits that stand for Latin letters.
_LOOKALIKE = str.maketrans("асеорхуіјѕԁԛԝһѵαοενρτικυАВЕКМНОРСТХУІЈЅ", "aceopxyijsdqwhvaoevptikuABEKMHOPCTXYIJS")
_LEET = str.maketrans("013457@$!|", "oieastasil")
#: Examples that train beside the labelled texts.
EXAMPLES = (
    (1, "What an idiot, did you even read this?"), (1, "You dumb moron, learn to code."), (1, "Fuck you and your review."), (1, "Piss off, you bastard!"), (1, "Whoever wrote this is a worthless piece of shit."), (1, "Listen, asshole, stop pinging me!!"), (1, "You are scum and I hate you."),
    (1, "I hate you, you disgusting creep."), (1, "She is a slut and a liar."), (1, "Shut your mouth, whore."), (1, "The new hire is a retard."), (1, "Only a braindead clown would merge that."), (1, "I will find you and break your legs."), (1, "I know where you live, watch your back."), (1, "He deserves a beating for this commit."),
    (1, "I will punch you in the face, prick."), (1, "Kill yourself."), (1, "I hope you die slowly."), (1, "Nobody would miss you, go die."), (1, "You are a waste of oxygen, rot in hell."), (1, "Immigrants are vermin, send them back."), (1, "Those people are animals and do not belong here."), (1, "Go back to your country, your kind is not wanted."),
    (1, "All of them are thieves and cannot be trusted."), (1, "Women belong in the kitchen, not in engineering."), (1, "That faggot broke the build again."), (1, "No nigger should touch this code."), (1, "Jews are a disease, gas them."), (1, "Send nudes or I reject it."), (1, "I am so horny, come and talk dirty with me."), (1, "Hot singles want to have sex tonight, free porn here."), (1, "Come over, I want to have sex with you all night."),
    (1, "Halt's Maul, du Wichser."), (1, "Du dumme Schlampe."), (1, "Fick dich, du Hurensohn!"), (1, "So ein Vollidiot, der gehört verprügelt."), (1, "Ausländer raus, das ist Ungeziefer."), (1, "Dieses Pack lügt immer, die gehören abgeschoben."), (1, "Die Schwuchtel soll verschwinden."), (1, "Stirb endlich, niemand würde dich vermissen."), (1, "Schick Nacktfotos, ich bin geil auf dich."), (1, "Ich finde dich und brech dir die Arme."),
    (1, "Ta gueule, connard."), (1, "Quelle salope, qu'elle dégage."), (1, "Va te faire foutre, fils de pute."), (1, "Pauvre con, tu es un débile."), (1, "Je vais te casser la gueule."), (1, "Va crever, personne ne te regretterait."), (1, "Sale arabe, retourne dans ton pays."), (1, "Ces étrangers sont des rats, dehors les voleurs."), (1, "Film porno gratuit, sexe gratuit ici."),
    (1, "Vete a la mierda, gilipollas."), (1, "Eres un imbécil y un inútil."), (1, "Cállate, hijo de puta."), (1, "Esa zorra no sabe nada."), (1, "Te voy a partir la cara."), (1, "Ojalá te mueras, nadie te echaría de menos."), (1, "Los inmigrantes son una plaga, vuelve a tu país."), (1, "Maricón de mierda, fuera de aquí."), (1, "Quiero follarte, mándame fotos de tus tetas."),
    (0, "Send SIGKILL to the child process if it ignores SIGTERM."), (0, "A zombie process stays until its parent waits for it."), (0, "Le serveur doit tuer le processus bloqué."), (0, "El servidor debe matar el proceso bloqueado."), (0, "Der Server muss den hängenden Prozess töten."), (0, "The old master is now a slave of the new one."), (0, "We can drop the dead code in this module."), (0, "Damn, these tests are slow."),
    (0, "The word list of the filter has entries such as 'idiot', 'slut' and 'moron'."), (0, "The report quoted a comment with the word 'bastard'; a moderator hid it."), (0, "This parser is idiot-proof."), (0, "It looks stupid simple, but the algorithm is right."), (0, "We need a dumb terminal to test the escape codes."), (0, "A naked pointer leaks here; use a smart one."), (0, "The column sex is one of m, f and x."), (0, "Le champ sexe est vide par défaut."), (0, "El campo sexo está vacío por defecto."),
    (0, "Strip the binary and dump its symbols."), (0, "A poison message stops the queue."), (0, "The penetration test found a weak token."), (0, "This is an ugly workaround, I hate it, but it passes the tests."), (0, "The out of memory killer stopped the daemon."), (0, "This design is wrong and the patch is bad; please rewrite it."), (0, "You broke the build; please rerun the tests."), (0, "Never trust input before it is checked."), (0, "The naming in this function is terrible."), (0, "You will lose your config if you use the default."),
    (0, "Le code est mauvais, merci de le reprendre."), (0, "Der Code ist schlecht, bitte überarbeiten."), (0, "El código es malo, hay que mejorarlo."), (0, "The policy forbids insults such as 'loser' and slurs."), (0, "Your token expires tomorrow; you can renew it here."), (0, "Du kannst den Zweig löschen, wenn du fertig bist."), (0, "Tu peux supprimer la branche quand tu as fini."), (0, "Puedes borrar la rama cuando termines."), (0, "Women and men use the form alike, says the survey of all users."), (0, "NOTE: READ THE WHOLE PAGE FIRST!"), (0, "Great work, thank you all!!"), (0, "The function returns the sorted list of keys."), (0, "All foreigners need a visa, says the form."),
)

CLASSES = tuple(LEXICON)
_PHRASES = {c: list(dict.fromkeys(p.strip() for line in t.split("\n") for p in (line.split("|") if "|" in line else line.split()) if p.strip())) for c, t in LEXICON.items()}
#: What the search for suspicious texts looks for; neutral and group words alone are no sign.
_SIGNS = [p for c in CLASSES if c not in ("neutral", "group") for p in _PHRASES[c]]
_VOCAB = frozenset(w for c in CLASSES for p in _PHRASES[c] for w in re.findall(r"\w+", p)) | SECOND | THIRD
_SKELETON: dict[str, list[str]] = {}
for _w in sorted(_VOCAB):
    _SKELETON.setdefault(re.sub(r"[aeiouy]", "", _w), []).append(_w)
_OF_LENGTH: dict[int, list[str]] = {}
for _w in [*_SIGNS, *sorted(_VOCAB)]:
    _OF_LENGTH.setdefault(len(_w), []).append(_w)
_JOINED = {p.replace(" ", ""): p for p in _SIGNS}
#: No spelling of more characters, repeated letters taken out, can be a word of the lexicon.
_LONGEST = max(map(len, [*_JOINED, *_VOCAB]))
_WEIGHT = {"insult": 3.0, "slur": 3.5, "harsh": 1.0, "dismiss": 2.0, "threat": 3.0, "wish": 3.5, "demean": 2.5, "sexual": 3.0, "neutral": -0.7, "group": 0.2}

_SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:[ \-._*]{1,3}[^\W\d_](?![^\W_])){3,}")
#: A word with signs or digits among its letters; it starts after white space or an opening sign, so long runs cost one scan.
_MIXED = re.compile(r"(?<![^\s\"'(,;:>-])(?=[a-z0-9@$*!#|]*[@$*!#013457|])(?=[a-z0-9@$*!#|]*[a-z])[a-z0-9@$*!#|]{2,}")
_LONG = re.compile(r"([^\W\d_])\1{2,}")
_FOREIGN = re.compile(r"[Ͱ-ϿЀ-ԯ]")
_LATIN = re.compile(r"[A-Za-z]")
_WORD = re.compile(r"\w+")
_COMBINING = re.compile(r"[\u0300-\u036f]+")
_CLAUSE = re.compile(r"[^.!?\n;]+[.!?]*")
_TOKEN = re.compile(r"[^\W\d_]+")
#: Words, and the signs that end clauses.
_PIECE = re.compile(r"[^\W\d_]+|[.!?\n;]")
_ENDS = frozenset(".!?\n;")
#: A word with exclamation marks among its letters.
_BANGED = re.compile(r"(?<![\w@$*#|!])[\w@$*#|]+!+[\w@$*#|!]*\w")
FEATURES = (
    *CLASSES, "score", "second_gap", "second", "third", "words", "caps", "bangs", "obfuscated", "foreign", "insult_density", "harsh_density", "worst_share", "quoted",
    "phrase_sum", "phrase_most", "phrase_density", "phrase_words", "phrases", "phrase_clauses", "worst_phrase_sum", "worst_phrase_most", "worst_cleared", "worst_cleared_most",
)
#: Words with any signs or digits among their letters, for phrases of words that no lexicon knows.
_LEETED = re.compile(r"(?<![\w@$*#|!])(?=[\w@$*#|!]*[@$*!#0-9|])(?=[\w@$*#|!]*[^\W\d_])[\w@$*#|!]+")
#: Words of a learned phrase; standard deviations above and below the share of toxic texts from which on a phrase is kept.
PHRASE_WORDS, LEAST_Z, MOST_CLEAR = 3, 2.5, -0.7
#: A phrase is learned from so many labelled texts at least.
LEAST_TEXTS = 3
FOLDS = 5


def fold(text: str) -> str:
    """Lower case, without accents, look-alike letters as Latin ones."""
    if text.isascii():
        return text.lower()
    t = _COMBINING.sub("", unicodedata.normalize("NFKD", text))
    if not t.isascii():
        t = (_WORD.sub(_latin, t) if _FOREIGN.search(t) else t).replace("’", "'").replace("ß", "ss")
    return t.lower()


def _latin(m: re.Match) -> str:
    """A word of mixed scripts, or one that looks Latin throughout, in Latin letters; any other word is left as it is."""
    t = m.group(0).translate(_LOOKALIKE)
    return t if t.isascii() or _LATIN.search(m.group(0)) else m.group(0)


def masked_words(text: str) -> int:
    """Words that mix Latin letters with look-alikes of other scripts."""
    return 0 if text.isascii() or not _FOREIGN.search(text) else sum(bool(_FOREIGN.search(w) and _LATIN.search(w)) for w in _WORD.findall(text))


@functools.lru_cache(maxsize=20000)
def _known(token: str) -> str | None:
    """The lexicon word that an obfuscated token spells."""
    t = token.lower()
    if len(_LONG.sub(r"\1", t)) > 2 * _LONGEST:
        return None
    for x in (t, t.rstrip("!")):
        if (plain := x.translate(_LEET)) in _VOCAB:
            return plain
    t = t.rstrip("!")
    squeezed = _LONG.sub(r"\1", t)
    for s in (squeezed, _LONG.sub(r"\1\1", t)):
        if s in _VOCAB:
            return s
    if re.search(r"[*@$!#]", t) and t[0].isalpha() and t[-1].isalpha():  # the ends are letters, or it is Markdown
        bare = re.sub(r"[aeiouy]", "", re.sub(r"[^a-z]", "", t))
        for w in _SKELETON.get(bare, ()):
            if len(w) == len(t):
                return w
        rx = re.compile("".join("[a-z ]" if c in "*@$!#" else re.escape(c) for c in t))
        return next((p for p in _OF_LENGTH.get(len(t), ()) if rx.fullmatch(p)), None)
    return None


def unmask(text: str) -> tuple[str, int]:
    """Folded text with obfuscated spellings replaced, and how many were."""
    t, n = text, 0

    def spaced(m):
        nonlocal n
        raw = m.group(0)
        joined = re.sub(r"[^\w]+", "", raw)
        gaps = re.sub(r"(?<=\w)[ \-._*](?=\w)", "", raw)
        words = re.sub(r"[^\w]+", " ", gaps).strip()
        if joined in _JOINED:
            n += 1
            return f" {_JOINED[joined]} "
        for k in range(min(len(joined), _LONGEST), 3, -1):  # the run may have swallowed a neighbouring one-letter word
            for w in (joined[:k], joined[-k:]):
                if w in _VOCAB:
                    n += 1
                    return joined.replace(w, f" {w} ", 1)
        return words if len(words) < len(raw) else raw

    t = _SPACED.sub(spaced, t)

    def odd(m):
        nonlocal n
        if w := _known(m.group(0)):
            n += 1
            return w
        return m.group(0)

    t = _MIXED.sub(odd, t)
    t, long = _LONG.subn(r"\1", t)
    return t, n + long


_AUTOMATA: dict[str, object] = {}


def _automaton(which: str):
    if which not in _AUTOMATA:
        import ahocorasick

        a = ahocorasick.Automaton()
        for c in CLASSES if which == "all" else [c for c in CLASSES if c not in ("neutral", "group")]:
            for p in _PHRASES[c]:
                old = a.get(p, ())
                a.add_word(p, (*old, (c, len(p))))
        a.make_automaton()
        _AUTOMATA[which] = a
    return _AUTOMATA[which]


#: Endings with which words of at least five letters are inflected.
_ENDINGS = frozenset(("s", "es", "e", "en", "n", "er", "as", "os"))


def _ends(text: str, end: int, c: str, n: int) -> bool:
    """Whether a match of class ``c`` and length ``n`` whose last letter is at ``end`` closes its word."""
    k = end + 1
    while k < len(text) and k <= end + 3 and text[k].isalnum():
        k += 1
    return k == end + 1 or c == "sexual" and n > 7 or n > 4 and c in ("insult", "slur", "sexual") and text[end + 1 : k] in _ENDINGS


def _matches(text: str) -> list[tuple[int, int, str]]:
    out = []
    for end, hits in _automaton("all").iter(text):
        for c, n in hits:
            s = end - n + 1
            if (s == 0 or not text[s - 1].isalnum()) and _ends(text, end, c, n):
                out.append((s, end + 1, c))
    return out


def _clause(raw: str, folded: str, n_odd: int, n_foreign: int) -> list[float]:
    count = dict.fromkeys(CLASSES, 0)
    places = []
    for s, e, c in _matches(folded):
        count[c] += 1
        if c in ("insult", "slur", "harsh", "threat", "wish"):
            places.append(s)
    toks = [(m.start(), m.group(0)) for m in _TOKEN.finditer(folded)]
    second = [p for p, w in toks if w in SECOND]
    gap = min((abs(p - q) for p in places for q in second), default=200)
    letters = sum(c.isalpha() for c in raw)
    n = max(1, len(toks))
    score = sum(_WEIGHT[c] * min(k, 4) for c, k in count.items()) + (1.0 if gap < 40 and places else 0)
    quoted = len(re.findall(r"['\"‘“«`][\w ]{3,20}['\"’”»`]", raw))
    return [*(float(count[c]) for c in CLASSES), score, float(min(gap, 200)), float(len(second)), float(sum(w in THIRD for _, w in toks)), float(n), sum(c.isupper() for c in raw) / max(1, letters), float(raw.count("!")), float(n_odd), float(n_foreign), count["insult"] / n, count["harsh"] / n, 0.0, float(quoted)]


def _capitals(text: str) -> int:
    """Capitals of the Latin-1 alphabet in ``text``."""
    a = np.frombuffer(text.encode("latin-1", "replace"), dtype=np.uint8)
    return int(np.count_nonzero((a - 65 < 26) | (a >= 192) & (a < 223)))


def _plain(raw: str, folded: str, n_odd: int, clauses: int, words: list[str] | None = None) -> list[float]:
    """The features of a text without any sign: those of a mean clause.  ``words``, if known, are its folded words."""
    if words is None:
        words = _TOKEN.findall(folded)
    count = dict.fromkeys(CLASSES, 0)
    for _, _, c in _matches(folded):
        count[c] += 1
    k = max(1, clauses)
    second, third = len([1 for w in words if w in SECOND]), len([1 for w in words if w in THIRD])
    n = max(1.0, len(words) / k)
    return [*(count[c] / k for c in CLASSES), sum(_WEIGHT[c] * min(m / k, 4) for c, m in count.items()), 200.0, second / k, third / k, n, _capitals(raw) / max(1, sum(map(len, words))), raw.count("!") / k, float(n_odd), float(masked_words(raw)), 0.0, 0.0, 0.0, 0.0]


def _signed(folded: str) -> bool:
    """Whether a word or phrase of the lexicon's classes of signs occurs."""
    for end, hits in _automaton("signs").iter(folded):
        for c, n in hits:
            s = end - n + 1
            if (s == 0 or not folded[s - 1].isalnum()) and _ends(folded, end, c, n):
                return True
    return False


_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[*range(97, 123), *range(65, 91)]] = 1
_KIND[[ord(c) for c in "013457"]] = 2
_KIND[[ord(c) for c in "2689"]] = 4
_KIND[[ord(c) for c in "*@$!#"]] = 8


def odd_texts(folded: list[str]) -> np.ndarray:
    """For each text whether it has letters spelled out one by one, starred or replaced by digits, or thrice in a row; all texts at once."""
    ends = np.cumsum([len(t) + 8 for t in folded])
    a = np.frombuffer(("\n" * 8).join(folded).encode("ascii", "replace") + b"\n" * 8, dtype=np.uint8)
    k = _KIND[a]
    letter, star = k == 1, k == 8
    word = (k == 1) | (k == 2) | (k == 4)
    alone = letter[1:-1] & ~word[:-2] & ~word[2:]
    found = [np.flatnonzero(alone[:-6] & alone[2:-4] & alone[4:-2] & alone[6:])]
    found.append(np.flatnonzero(letter[:-2] & star[1:-1] & (letter[2:] | star[2:]) & ((a[1:-1] != 33) | letter[2:])))
    found.append(np.flatnonzero(letter[:-2] & (k[1:-1] == 2) & letter[2:]))
    found.append(np.flatnonzero(letter[2:] & (a[:-2] == a[1:-1]) & (a[1:-1] == a[2:])))
    out = np.zeros(len(folded), dtype=bool)
    for f in found:
        out[np.searchsorted(ends, f, "right")] = True
    return out


def _whole_spellings(text: str) -> str:
    """``text`` with other signs for the full stops and exclamation marks inside obfuscated words, which would cut them into clauses."""

    def dotted(m):
        raw = m.group(0)
        return raw.replace(".", "-") if "." in raw and unmask(fold(raw))[1] else raw

    def banged(m):
        raw = m.group(0)
        return next((x for x in (raw.replace("!", "1"), raw.replace("!", "*")) if _known(fold(x))), raw)

    return _BANGED.sub(banged, _SPACED.sub(dotted, text))


def _worst(text: str, odd: bool) -> tuple[list[float], str]:
    """The features of a text, and its worst clause, folded; "" where none has a sign."""
    best, total, hit, changed, where = None, 0, 0, 0, ""
    if odd:
        text = _whole_spellings(text)
    for m in _CLAUSE.finditer(text):
        raw = m.group(0)
        total += 1
        f, n = fold(raw), 0
        if odd and (_SPACED.search(f) or _MIXED.search(f) or _LONG.search(f)):
            f, n = unmask(f)
            changed += n
        if not _signed(f):
            continue
        x = _clause(raw, f, n, masked_words(raw))
        hit += x[len(CLASSES)] > 2
        if best is None or x[len(CLASSES)] > best[len(CLASSES)]:
            best, where = x, f
    if best is None:
        return _plain(text, fold(text), changed, total), ""
    best = list(best)
    best[-2] = hit / max(1, total)
    return best, where


class Phrases:
    """Learned phrases with their weights (standard scores of their share of toxic texts): ``weights[p, f]`` is the weight of phrase p
    by the texts of all folds but f, the last column by all texts; 0 where it says nothing."""

    def __init__(self, counts: pd.DataFrame, n: np.ndarray, toxic: np.ndarray):
        """``counts``: gram, fold, n, toxic; ``n`` and ``toxic`` are the labelled texts and their labels' sum by fold."""
        whole = counts.groupby("gram")[["n", "toxic"]].sum()
        columns = []
        for left_out in (*range(len(n)), None):
            k, t, base_n, base_t = whole["n"], whole["toxic"], n.sum(), toxic.sum()
            if left_out is not None:
                own = counts[counts["fold"] == left_out].set_index("gram").reindex(whole.index, fill_value=0)
                k, t, base_n, base_t = k - own["n"], t - own["toxic"], base_n - n[left_out], base_t - toxic[left_out]
            p = np.clip(base_t / base_n if base_n else 0.5, 0.01, 0.99)
            z = ((t - k * p) / np.sqrt(k * p * (1 - p)).clip(lower=1e-9)).to_numpy(float)
            columns.append(np.where((k.to_numpy() >= LEAST_TEXTS) & ((z > LEAST_Z) | (z < MOST_CLEAR)), z, 0.0))
        weights = np.stack(columns, axis=1)
        kept = np.flatnonzero(weights.any(axis=1) & (whole.index.str.len() > 2))
        self.grams, weights = whole.index[kept].tolist(), weights[kept]
        parts = [g.split(" ") for g in self.grams]
        self.vocab = {w: i for i, w in enumerate(sorted({w for ws in parts for w in ws}), 1)}
        self.vocab |= dict.fromkeys(_ENDS, -1)
        self.base = len(self.vocab) + 1
        # For each length the phrases' keys in order, and their rows of weights.
        self.keys, self.weights = [], []
        for length in range(1, PHRASE_WORDS + 1):
            at = [i for i, ws in enumerate(parts) if len(ws) == length]
            key = np.array([self._key([self.vocab[w] for w in parts[i]]) for i in at], dtype=np.int64)
            order = np.argsort(key)
            self.keys.append(key[order])
            self.weights.append(weights[np.array(at, dtype=np.int64)[order]])

    def _key(self, ids: list) -> int:
        key = ids[0]
        for i in ids[1:]:
            key = key * self.base + i
        return key

    def weight(self, gram: str) -> float:
        """The weight of a phrase by all texts."""
        ids = [self.vocab.get(w, 0) for w in gram.split(" ")]
        k = self.keys[len(ids) - 1]
        at = int(np.searchsorted(k, self._key(ids)))
        return float(self.weights[len(ids) - 1][at, -1]) if at < len(k) and k[at] == self._key(ids) else 0.0

    def look(self, texts: list[str | list[str]], fold: int = -1) -> np.ndarray:
        """For each folded text, or list of its words and the signs that end clauses: of the clause whose phrases weigh most the sum of its six greatest weights, the greatest, phrases a
        word, share of words in phrases, phrases; the share of clauses with a heavy phrase; of the whole text the sum of the weights of
        its phrases that speak against abuse, and the lowest of them.  All texts at once."""
        out = np.zeros((len(texts), 8))
        look, flat, lens = self.vocab.get, [], []
        for t in texts:
            ids = [look(w, 0) for w in (t if isinstance(t, list) else _PIECE.findall(t))]
            lens.append(len(ids) + 1)
            flat += ids
            flat.append(-1)
        ids = np.array(flat, dtype=np.int64)
        if not len(ids) or not self.grams:
            return out
        text = np.repeat(np.arange(len(texts)), lens)
        clause = np.cumsum(ids == -1)
        n_clauses = int(clause[-1]) + 1
        words = np.bincount(clause[ids >= 0], minlength=n_clauses)
        at, weight, covered, key = [], [], np.zeros(len(ids), dtype=bool), ids
        place = np.flatnonzero(ids > 0)
        key = ids[place]
        for length, (keys, weights) in enumerate(zip(self.keys, self.weights), 1):
            if length > 1:
                more = place + length - 1 < len(ids)
                place, key = place[more], key[more]
                more = ids[place + length - 1] > 0
                place, key = place[more], key[more] * self.base + ids[place[more] + length - 1]
            if len(keys) and len(place):
                spot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                w = np.where(keys[spot] == key, weights[spot, fold], 0.0)
                hit = np.flatnonzero(w)
                at.append(place[hit])
                weight.append(w[hit])
                for step in range(length):
                    covered[place[w > 0] + step] = True
        at, weight = (np.concatenate(at), np.concatenate(weight)) if at else (np.zeros(0, dtype=np.int64), np.zeros(0))
        low = weight < 0
        np.add.at(out[:, 6], text[at[low]], weight[low])
        np.minimum.at(out[:, 7], text[at[low]], weight[low])
        c, w = clause[at[~low]], weight[~low]
        order = np.lexsort((-w, c))
        c, w = c[order], w[order]
        if len(c):
            first = np.flatnonzero(np.r_[True, np.diff(c) != 0])
            rank = np.arange(len(c)) - np.repeat(first, np.diff(np.r_[first, len(c)]))
            of = c[first]
            total = np.bincount(c[rank < 6], w[rank < 6], n_clauses)[of]
            count, inside = np.bincount(c, minlength=n_clauses)[of], np.bincount(clause[covered], minlength=n_clauses)[of]
            rows = np.stack([total, w[first], count / words[of], inside / words[of], count], axis=1)
            # A clause begins with the sign that ends the one before, which may be in the text before.
            where = text[np.minimum(np.searchsorted(clause, of) + (of > 0), len(text) - 1)]
            best = np.lexsort((-total, where))
            lead = best[np.r_[True, np.diff(where[best]) != 0]]
            out[where[lead], :5] = rows[lead]
            filled = np.flatnonzero(words)
            n_of = np.bincount(text[np.minimum(np.searchsorted(clause, filled) + (filled > 0), len(text) - 1)], minlength=len(texts))
            out[:, 5] = np.bincount(where[w[first] > 4], minlength=len(texts)) / np.maximum(1, n_of)
        return out


def plain_words(folded: str, odd: bool) -> str:
    """``folded``; in odd texts digits and signs that stand for letters are read as these, spaced letters as one word."""
    if odd:
        folded = _SPACED.sub(lambda m: " " + re.sub(r"[^\w]+", "", m.group(0)) + " ", folded)
        folded = _LONG.sub(r"\1", _LEETED.sub(lambda m: m.group(0).translate(_LEET), folded))
    return folded


def grams(plain: str) -> set[str]:
    """The phrases of a text, none across the end of a clause."""
    clauses = [_TOKEN.findall(c) for c in _CLAUSE.findall(plain)]
    return {" ".join(ws[i : i + k]) for ws in clauses for i in range(len(ws)) for k in range(1, min(PHRASE_WORDS, len(ws) - i) + 1)}


def batch_features(texts: list[str | None], phrases: Phrases | None = None, fold_of: int = -1) -> np.ndarray:
    """The dense features of each text: those of its worst clause; ``fold_of`` is the fold in which all of them are, if they train."""
    folded = [fold(t) if t else "" for t in texts]
    odd = odd_texts(folded) if folded else []
    rows, worst, pieces = [], [], []
    for t, f, o in zip(texts, folded, odd):
        ws = _PIECE.findall(plain_words(f, bool(o)))
        if t and (o or _signed(f)):
            x, w = _worst(t, bool(o))
        else:
            x, w = _plain(t or "", f, 0, 1 + len([1 for a in ws if a in _ENDS]), ws), ""
        rows.append(x)
        worst.append(w)
        pieces.append(ws)
    x = np.array(rows, dtype=np.float64).reshape(len(rows), -1)
    if phrases is None:
        return np.hstack([x, np.zeros((len(rows), 10))])
    whole = phrases.look(pieces, fold_of)
    return np.hstack([x, whole[:, :6], phrases.look(worst, fold_of)[:, [0, 1, 6, 7]]])


def text_features(text: str | None, phrases: Phrases | None = None) -> list[float]:
    return batch_features([text], phrases)[0].tolist()


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        folded = [fold(t) for t in pdf["text"]]
        for f, o, k, y in zip(folded, odd_texts(folded) if folded else [], pdf["fold"], pdf["y"]):
            rows += [(g, k, y) for g in grams(plain_words(f, bool(o)))]
        yield pd.DataFrame(rows, columns=["gram", "fold", "y"])


def learn_phrases(labelled: DataFrame, max_phrases: int = 50_000) -> Phrases:
    """Phrases of ``labelled`` (text, y, fold): those commoner in toxic texts, and those with a word of the general lexicon, which may
    speak against abuse; of more than ``max_phrases``, those in most toxic texts are kept."""
    per_fold = labelled.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("toxic")).toPandas().set_index("fold").reindex(range(FOLDS), fill_value=0)
    counts = labelled.mapInPandas(_count, "gram string, fold int, y double").groupBy("gram", "fold").agg(F.count("*").alias("n"), F.sum("y").alias("toxic"))
    base = per_fold["toxic"].sum() / max(1, per_fold["n"].sum())
    known = F.arrays_overlap(F.split("gram", " "), F.array(*map(F.lit, sorted({w for p in _SIGNS for w in p.split(" ") if len(w) > 3}))))
    kept = (
        counts.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("toxic").alias("t"), F.collect_list(F.struct("fold", "n", "toxic")).alias("f"))
        .where((F.col("n") >= LEAST_TEXTS) & ((F.col("t") / F.col("n") > float(base)) | known))
        .orderBy(F.desc("t"), "gram").limit(max_phrases).select("gram", F.explode("f").alias("f")).select("gram", "f.*")
    )
    return Phrases(kept.toPandas(), per_fold["n"].to_numpy(float), per_fold["toxic"].to_numpy(float))


def train(documents: DataFrame, doc_labels: DataFrame, *, max_labelled: int = 20000, max_phrases: int = 50_000) -> tuple[Boosted, Phrases]:
    """The model and its learned phrases; at most ``max_labelled`` labelled documents, those with the smallest hash of their id, train."""
    labels = doc_labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.avg("toxic").cast("double").alias("y"))
    labels = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(labels), "doc_id")
    # Copies of one text are in one fold.
    labelled = cut(texts.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")))
    phrases = learn_phrases(labelled, max_phrases)
    known = documents.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, part in pdf.groupby("fold"):
                yield pd.DataFrame({"doc_id": part["doc_id"], "y": part["y"], "x": batch_features(part["text"].tolist(), known.value, int(k)).tolist()})

    got = labelled.mapInPandas(run, "doc_id bigint, y double, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    ex = [(text_features(t, phrases), y) for y, t in EXAMPLES]
    x = np.array([*got["x"].tolist(), *(a for a, _ in ex)], dtype=np.float64)
    y = np.array([*got["y"].tolist(), *(float(b) for _, b in ex)])
    shuffled = np.random.default_rng(3).permutation(len(y))
    return Boosted(rounds=60, depth=3, least=15.0, ridge=5.0).fit(x[shuffled], y[shuffled], np.ones(len(y))), phrases


def score(documents: DataFrame, doc_labels: DataFrame, *, max_labelled: int = 20000) -> DataFrame:
    """``(doc_id, source, score)`` of every row of ``documents``."""
    model, phrases = train(documents, doc_labels, max_labelled=max_labelled)
    known = documents.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = batch_features(pdf["text"].tolist(), known.value)
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "score": model.probability(x)})

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"), "text").where("doc_id is not null").mapInPandas(run, "doc_id bigint, source string, score double")


def abusive(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Distinct ``doc_id`` with a score of at least ``threshold``."""
    return scores.where(F.col("score") >= threshold).select("doc_id").distinct()


def rates(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(source, n_docs, n_abusive, rate)``."""
    return scores.groupBy("doc_id").agg(F.max("score").alias("score"), F.min("source").alias("source")).groupBy("source").agg(F.count("*").alias("n_docs"), F.sum((F.col("score") >= threshold).cast("bigint")).alias("n_abusive")).withColumn("rate", F.round(F.col("n_abusive") / F.col("n_docs"), 6))
