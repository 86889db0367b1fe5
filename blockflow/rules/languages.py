"""Language codes and marker words.

Everything below is a fixed value: the lists decide which texts count as which language, so
they have to be stated as they are.
"""

ALIASES = {"zh-cn": "zh", "zh-tw": "zh", "spa": "es", "eng": "en", "jpn": "ja", "kor": "ko"}

ACTIVE = ["es", "en", "pt", "ja", "ko", "zh"]
DISABLED = ["fr", "de", "it"]
SUPPORTED = ["auto", "en", "es", "ja", "ko", "pt", "zh", "zh-cn", "zh-tw"]

SPANISH_MARKS = "áéíóúñüÁÉÍÓÚÑÜ¿¡"

SPANISH_WORDS = """
el la los las que en un una de con es para por si y pero como cómo mas más bien todo todos esta
este tus sus mi me se lo le te al del tú yo criar villano villanos correcto correctamente ayudan
administrar subimos oficial visitas hacer hola gracias capitulo capítulo temporada realmente
increible increíble increiblemente nunca siempre sino tambien también ahora entonces cada aunque
algo alguien nada nadie quizas quizás talvez mismo misma propio propia gran grande mejor peor
otro otra otros otras poco poca unos unas bueno buena malo mala primero primera ultimo último
solo sólo aun aún sobre bajo contra entre ante segun según mediante durante despues después
antes luego pronto tarde temprano nuestro nuestra vuestro vuestra aquel aquella esto eso aquello
ese esa esos esas donde dónde cuando cuándo cual cuál quien quién cuanto cuánto cuan cuán
""".split()

SPANISH_VERB_ENDINGS = """
arme erme irme arte erte irte arse erse irse arle erle irle arnos ernos irnos arlos erlos irlos
ar er ir
""".split()

# Portuguese, used by the simple tagger: two of these, or one of the distinctive ones.
PORTUGUESE_WORDS = "eu amo estou voce você nao não obrigado obrigada quero posso vamos".split()
PORTUGUESE_DISTINCTIVE = "obrigado obrigada voce você nao não".split()

# Markers of a second language inside one text.
MIXED_MARKERS = {
    "es": """el la los las es un una hola quiero puedo puedes vamos tengo tienes mi amigo amiga
             dice digo casa mundo nuevo nueva grande mañana gracias adiós ahora estás estoy porque
             también dónde cómo esto eso hacer""".split(),
    "en": """the and this that you your with from what where why please want need go home here
             there okay sorry not dont don't i my says said are am love hello world friend stop
             come look run wait really house big is was""".split(),
    "pt": """eu amo sou estou você voce não nao vocês voces obrigado obrigada quero posso vamos
             casa amanhã amanha""".split(),
}
SINGLE_ENGLISH_MARKERS = "you your the hello my i".split()
SINGLE_DISTINCTIVE_MARKERS = {
    "es": "hola gracias adiós adios mañana manana quiero puedo dónde donde cómo como".split(),
    "pt": "você voce vocês voces obrigado obrigada não nao amanhã amanha".split(),
}

# Frequent words that show a text to be in its declared target language.
COMMON_WORDS = {
    "es": "el la los las un una de en que y no sí si para con hola mundo".split(),
    "en": "the a an of in that and is are not for with hello world".split(),
    "fr": "le la les un une de des et est pas bonjour".split(),
    "de": "der die das ein eine und ist nicht hallo".split(),
    "it": "il lo la gli un una di e è non ciao".split(),
    "pt": "o a os as um uma de e é não olá".split(),
}

# Scripts, as regular-expression classes.
KANA = r"[\x{3040}-\x{30ff}]"
HANZI = r"[\x{4e00}-\x{9fff}]"
HANGUL = r"[\x{ac00}-\x{d7a3}]"
SCRIPTS = {
    "ru": r"[А-Яа-яЁё]",
    "uk": r"[А-Яа-яІіЇїЄєҐґ]",
    "bg": r"[А-Яа-я]",
    "ar": r"[\x{0600}-\x{06ff}]",
    "fa": r"[\x{0600}-\x{06ff}]",
    "he": r"[\x{0590}-\x{05ff}]",
    "el": r"[\x{0370}-\x{03ff}]",
    "hi": r"[\x{0900}-\x{097f}]",
    "bn": r"[\x{0980}-\x{09ff}]",
    "th": r"[\x{0e00}-\x{0e7f}]",
    "ka": r"[\x{10a0}-\x{10ff}]",
    "hy": r"[\x{0530}-\x{058f}]",
}

# Honorifics after an isolated name, and how they are written in Latin letters.
HONORIFICS = {
    "ja": {"さん": "-san", "ちゃん": "-chan", "くん": "-kun", "様": "-sama", "さま": "-sama",
           "先輩": "-senpai", "先生": "-sensei"},
    "ko": {"씨": "-ssi", "님": "-nim", "군": "-gun", "양": "-yang", "선배": "-sunbae",
           "후배": "-hubae"},
}
TITLED_HONORIFICS = ["さん", "様", "さま"]
HONORIFIC_NAME = {
    "ja": r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}々]+",
    "ko": r"[\x{ac00}-\x{d7a3}]{2,5}",
}
TITLE_WORDS = r"(?iuU)\b(?:sr\.?|sra\.?|señor(?:a)?|mr\.?|mrs\.?)\b"
