r"""Regular expressions for margins, stamps, regions and logs.

Fixed values. Patterns are written for Java: ``(?iuU)`` ignores case and makes ``\b``, ``\w``
and ``\d`` Unicode-aware.
"""

WATERMARKS = [
    r"zonaolympus[\s-]?com",
    r"\b1\s*[\s-]?c\s*[\s-]?2\s*[\s-]?e\b",
    r"\bhtps?\s*[:\s/'\"\\]",
    r"[a-z][_'\"\s]\s*(?:com|net|org|xyz|io)\b",  # one letter before stands for a word
]
URLS = r"https?://|www\.|\.(com|net|org|xyz|io)\b"
MARGIN_NOISE = [
    r"\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}",
    r"\d{1,2}[/.\-]\d{1,2}1?\d{2}\b",
    r"\d{1,2}[:.]\d{2}\s*([ap]\.?\s?m\.?)?",
    r"^\d{1,4}\s*/\s*\d{1,4}$",
    r"\b\d{1,4}\s+de\s+\d{1,4}\b",
    r"\bp[aá]g(?:ina)?\.?\s?\d{1,4}\b",
    r"\b(?:p[aá]g(?:ina)?|page)\s+\d+\s+(?:de|of)\s+\d+\b",
    r"\b\d{8,14}[A-Za-z0-9_\-]*\b",
    r"\b\d{1,6}\s*[,.]?\s*\d{1,4}\s*p\.?m\.?\b",
    r"\b\d{1,4}\s*p\.?m\.?\b",
]
SYMBOLS = r"[@#$%^&*()+={}\[\]|:;<>/\\]"

REGION_KEYWORDS = ["bubble", "balloon", "speech", "dialog", "thought", "caption", "narration",
                   "narrative", "cartel", "title", "text", "letter", "sfx", "sound"]

# label substring → semantic type; the first line that matches wins
TYPE_KEYWORDS = [
    ("title", ["title", "chapter", "heading"]),
    ("header", ["header", "caption", "narrat", "cartel"]),
    ("sfx", ["sfx", "sound", "onomat"]),
    ("thought", ["thought", "thinking"]),
    ("dialogue", ["dialog", "speech", "bubble", "balloon"]),
]

NOISE_TYPES = ["image", "footer", "page_number"]

ENGINE_WEIGHTS = {"easyocr": 1.0, "rapid": 0.9, "unlimited": 1.1, "yolo": 0.9}
TYPE_WEIGHTS = {"title": 1.15, "header": 1.05}
TYPE_REINFORCE = {"title": 0.20, "header": 0.18, "text": 0.15}

# source → (engines, detector) in page exports
EXPORT_ENGINES = [
    (["yolo"], ["easyocr", "rapid", "yolo"], "yolo"),
    (["ctd", "ctd_line", "ctd_mask"], ["easyocr", "rapid", "comic_text_detector"], "ctd"),
    (["unlimited", "uocr", "vlm"], ["easyocr", "rapid", "vlm"], "vlm"),
]
EXPORT_DEFAULT = (["easyocr", "rapid"], "hibrido")

DETECTION_TAG = (r"<\|det\|>(\w+)\s*\[(\d+),\s*(\d+),\s*(\d+),\s*(\d+)\]\s*<\|/det\|>"
                 r"[ \t]*([^\n]*)")

# Log categories, first match wins. The final timeout stands before the plain one so that it can
# win, and the pattern for invalid results takes the word with or without its accent.
LOG_CATEGORIES = [
    ("OCR_VACIO", r"\[process-page\] OCR \([^)]+\): 0 bloques"),
    ("OCR_FILTRO_PRE", r"\[OCR\] Filtrando .+? pre-merge:"),
    ("OCR_FILTRO_POST", r"\[OCR\] Filtrando .+? post-merge:"),
    ("OCR_NOISE_DETECTADO", r"\[translate\] OCR noise detectado"),
    ("SAME_TEXT_DESCARTADO", r"\[translate\] .+? mismo texto .+?— descartado"),
    ("TRADUCCION_INVALIDA", r"\[translate\] .+? inv[aá]lido:"),
    ("FALLBACK_USADO", r"\[translate\] Usando fallback"),
    ("TODOS_FALLARON", r"\[translate\] Todos los métodos fallaron"),
    ("ENGINE_ERROR", r"\[(?:google|argos|CT2|offline)\] Error"),
    ("BLOQUE_ERROR", r"Error traduciendo bloque idx"),
    ("CACHE_HIT", r"\[translate\] Cache HIT:"),
    ("RATE_LIMIT_BACKOFF", r"\[google\] Rate limit backoff"),
    ("RATE_LIMIT_DETECTADO", r"\[google\] ¡Rate limit detectado"),
    ("GOOGLE_UNCHANGED_COUNT", r"\[google\] Texto sin cambios \(\d+/\d+\)"),
    ("LANGDETECT_SOBRESCRITO", r"\[langdetect\]"),
    ("TIMEOUT_DEFINITIVO", r"TIMEOUT definitivo"),
    ("TIMEOUT_PAGINA", r"TIMEOUT"),
    ("ERROR_CONEXION", r"ERROR conexión"),
    ("RENDER_ERROR", r"ERROR render"),
    ("SIN_TRAD", r"(?:SIN_TRAD|PARCIAL)(?:_R\d)?\b"),
]
LOST_CATEGORIES = ["SAME_TEXT_DESCARTADO", "TRADUCCION_INVALIDA", "TODOS_FALLARON"]
LOG_TEXT = r"text='([^']+)'"

# Typed log events: kind → (pattern, names of the captured numbers)
LOG_EVENTS = [
    ("pbatch", r"\[process-page-batch\] (\d+) páginas, (\d+) bloques, ([\d.]+)s \(OCR:([\d.]+)s\)",
     ["pages", "blocks", "total_s", "ocr_s"]),
    ("req", r"\"(?:POST|GET) /api/[^ ]+ HTTP/1.1\" (\d+)", ["status"]),
    ("yolo", r"\[YOLO\] (\d+) regiones de diálogo detectadas", ["regions"]),
    ("fase6", r"Fase 6 \(YOLO\): (\d+) regiones .*?(\d+) bloques recuperados",
     ["regions", "recovered"]),
    ("fbatch", r"Página (\d+): Fase 6 (\d+) híbrido \+ (\d+) YOLO → (\d+)",
     ["page", "hybrid", "yolo", "total"]),
    ("ppage", r"\[process-page\] ([\d.]+)s \| (\d+) bloques", ["total_s", "blocks"]),
    ("trigger_hit", r"decisión cacheada por firma", []),
    ("negative_hit", r"§8\.4\.1: firma.*repetitiva", []),
    ("fusion", r"\[process-page\] Fusión:", []),
    ("fusion_batch", r"\[fusion-batch\] Página \d+: \d+ híbrido \+ \d+ U-OCR \(batch\) →", []),
]
