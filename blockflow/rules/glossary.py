r"""Ordered substitutions before and after translation.

Fixed values. Rules apply in the order written, ignoring case; ``$1`` is the first group.
"""

BEFORE = [
    (r"\bCoirectamente\b", "Correctamente"),
    (r"\bVilianos\b", "Villanos"),
    (r"\bYilianos\b", "Villanos"),
    (r"\bIFMPORAOA1\b", "TEMPORADA 1"),
    (r"\bIFMPORAOA\b", "TEMPORADA"),
    (r"\bTEMPORADA1\b", "TEMPORADA 1"),
    (r"\bTEMPORADA(\d+)\b", "TEMPORADA $1"),
    (r"\btuis\b", "tus"),
    (r"\bvisitos\b", "visitas"),
    (r"\bporu\b", "para"),
    (r"\bAdhniaistrur\b", "Administrar"),
    (r"\belscon\b", "el scan"),
    (r"\bIo web\b", "la web"),
    (r"\bJPuede\b", "¿Puede"),
    (r"\bSIEMPPE\b", "SIEMPRE"),
    (r"\bEMPPEDECIBLE\b", "IMPREDECIBLE"),
    (r"\bPELACIONADO\b", "RELACIONADO"),
    (r"\bTRAJCÓN\b", "TRAICIÓN"),
    (r"\bTRAIQÓN\b", "TRAICIÓN"),
    (r"\b@NCO\b", "CINCO"),
    (r"\bNCO\b", "CINCO"),
    (r"\bNC0\b", "CINCO"),
    (r"\bLaaYUDa\b", "La ayuda"),
    (r"\bCavBrE\b", "Cabre"),
    (r"\bHANTENÍA\b", "MANTENÍA"),
    (r"\bNEŒSITABA\b", "NECESITABA"),
    (r"\bNEŒSTO\b", "NECESITO"),
    (r"\bMucha\s+DOdaS\b", "Muchas dudas"),
    (r"\bUn\s+Scomumano\b", "Un ser humano"),
    (r"\bcnar\b", "criar"),
    (r"\bccrrettimerte\b", "correctamente"),
    (r"\baiar\b", "criar"),
    (r"\bMUESIRA\b", "MUESTRA"),
    (r"\bPaDRiNO\b", "PADRINO"),
    (r"\bScomumano\b", "ser humano"),
    (r"\bConFguroción\b", "Configuración"),
    (r"\bconfguroción\b", "configuración"),
    (r"\b0\b", "a"),
    (r"\bmuesira\b", "muestra"),
    (r"\bScomunano\b", "ser humano"),
    (r"\bshInel\b", "Shinel"),
    (r"\b@\b", ""),
    (r"@", ""),
    (r"\bC0M0\b", "COMO"),
    (r"\bC0RRECTAMENTE\b", "CORRECTAMENTE"),
    (r"\bC0RREC\b", "CORREC"),
    (r"\bSer1e\b", "Serie"),
    (r"\b5in\b", "sin"),
    (r"\bR\b", "Y"),
]

AFTER = [
    (r"\bTEMPORARY\s+(\d+)\b", "SEASON $1"),
    (r"\bTEMPORARILY\s+(\d+)\b", "SEASON $1"),
    (r"\bTEMPORARY(\d+)\b", "SEASON $1"),
    (r"\bTEMPORARILY(\d+)\b", "SEASON $1"),
    (r"\bSCAN\b", "scan"),
    (r"\bSCANLATION\b", "scanlation"),
    (r"\bCONFIGURATION\b", "Settings"),
    (r"\bPAGE\b", "page"),
    (r"\b1[erro]{1,3}\b", "First"),
    (r"\b1[da]\b", "First"),
    (r"\b2[do]{1,3}\b", "Second"),
    (r"\b2[da]\b", "Second"),
    (r"\b3[erro]{1,3}\b", "Third"),
    (r"\b3[da]\b", "Third"),
    (r"\bPRIMERO\b", "FIRST"),
    (r"\bPRIMERA\b", "FIRST"),
    (r"\bSEGUNDO\b", "SECOND"),
    (r"\bSEGUNDA\b", "SECOND"),
    (r"\bTERCERO\b", "THIRD"),
    (r"\bTERCERA\b", "THIRD"),
]
