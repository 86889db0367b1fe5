"""Sound effects: three rule sets, kept apart because they answer different questions.

Fixed values.
"""

EFFECT_TYPES = ["sfx", "sound", "sound_effect", "onomatopoeia", "onomatopeya"]
NAME_TYPES = ["name", "proper_name", "character", "character_name", "person", "person_name"]
SPOKEN_TYPES = ["dialogue", "speech", "thought", "title", "header", "caption", "narration",
                "narrative", "cartel"]

# Translator rule set.
NOT_EFFECTS = """
pero como cómo mas más sin con que para por desde hasta entre sobre segun según ella este esta
estos estas ese esa esos esas aquel aquella todo toda todos todas otro otra nadie algo nada cada
tanto tanta varios varias eres tiene tienen hacer poder deber saber querer debe puede sabe quiere
hace dice tener estar nunca siempre menos cerca lejos luego antes despues después mismo misma aún
aun tarde temprano pronto todavía también tampoco bien mal gran casi solo sólo fue era son has han
sea sean fuera fuese contra mediante durante excepto salvo incluso además acerca capitulo capítulo
temporada
""".split()
INTERJECTIONS = "ah ahh ay hey help no oh ouch ow please sorry stop wait what why yes".split()
ROMANISED = """
DON DOOON BAKU BOKU GARA GORO KARA PACHIN PAN PAKU PON ZUDON ZUBAN GAKU GYAA HAA HYUU KYUU MOKU
NYUU PIKU PUN PURU PYON SHIN SHUU TON TSU UZU WAKU ZU ZUN ZUZU BAAM BOOM CRASH SLAM THUD WHAM ZAP
""".split()
EFFECT_PATTERNS = [
    r"(?i)^([A-Z]{2,})\s+\1+$",
    r"(?i)^[A-Z]{3,}\s+\d+$",
    r"^[A-Z]{3,8}$",
    r"(?i)^[A-Z]{3,}[!?.…:]+$",
    r"(?i)^(" + "|".join(ROMANISED) + r")\d*[!?.]*$",
    r"^\*[^*]+\*$",
]

# Quality rule set.
KNOWN_EFFECTS = """
bang boom crash click clack slam smash splash tap knock thud thump sigh gasp hiss buzz ring ding
dong pop zap pow kaboom pum zas don doki zudon zuban pachin grrr ah oh eh
""".split()

# Repair rule set.
REPAIR_NOT_EFFECTS = """
EL LA LOS LAS UN UNA UNOS UNAS DEL CON POR QUE QUÉ SER ESTA ESTE ES NO SI YA PERO MAS MÁS SUS ERA
HAN LES LE TUS NOS SON AL MI TU SE TE ME LO DE EN A Y O NI VA VE FUE IR HAY HE HA HAS SOY ERES SEA
TAN TAL AH OH EH AY OK BIEN MAL TODO SOLO SÓLO MUY VALE LISTO CLARO CIERTO BUENO MALO COMO CÓMO
AHORA HOY
""".split()
REPAIR_EFFECTS = """
BOOM PUM ZAS CRASH CLICK PLOP TOC RING FLASH BOING POW BANG SMASH SPLASH BUMP THUD WHAM GRRR GRR
CLANG SNIFF GROAN SLAM BEEP WOOSH KABOOM RUMBLE SQUEAK WHIR ZOOM VROOM SCREECH GROWL HOWL SNAP
CRACKLE POP FIZZ HISS BUZZ DING DONG SPLAT SQUISH WHOOSH HUH HEH HAH HMPH PSST SHH GASP PANT PHEW
WHEW SIGH UFF OW OUCH AY OY BAH MEH ACK EEK TAP KNOCK RAP PIT PAT
""".split()

# Consonant-only short words that are real.
SHORT_WORDS = "dr mr sr st jr vs tv cd pc ok km wc".split()
