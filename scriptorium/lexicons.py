"""Default vocabularies and rule sets.  Every operator takes its own as an argument."""

from scriptorium.functions.rules import rule

# ---- Fixed values: keyword rules for the section label of a chunk, first rule that holds wins. ----
ABSTRACT_WORDS = (
    "abstract", "resumo", "summary", "síntese", "introduction", "introdução", "overview", "visão geral",
    "executive summary", "sumário executivo",
)
METHODOLOGY_WORDS = (
    "methodology", "metodologia", "method", "método", "approach", "abordagem", "procedure", "procedimento",
    "technique", "técnica", "experimental", "experimental setup", "setup experimental",
)
RESULT_WORDS = (
    "results", "resultados", "findings", "descobertas", "analysis", "análise", "discussion", "discussão",
    "conclusions", "conclusões", "outcome", "desfecho",
)
DEFINITION_INDICATORS = (
    "define", "defined", "definition", "means", "refers to", "is a", "stands for", "definir", "definido", "definição",
    "significa", "refere-se", "é um", "representa", "acronym", "abbreviation", "acrônimo", "abreviação", "sigla",
    "terminology", "terminologia", "glossary", "glossário",
)
DEFINITION_TERMS = (
    "insim", "ft", "simulator", "simulador", "eclipse", "cmg", "petrel", "reservoir", "reservatório", "porosity",
    "porosidade", "permeability", "permeabilidade", "saturation", "saturação", "pressure", "pressão", "well", "poço",
    "production", "produção", "injection", "injeção", "oil", "óleo", "gas", "gás", "water", "água", "pvt", "eos",
    "black oil", "compositional", "thermal", "streamline", "front tracking", "finite difference", "finite element",
)
EQUATION_WORDS = ("=", "∂", "∇", "∫", "∑", "equation", "equação", "formula", "fórmula")
FIGURE_WORDS = (
    "figure", "figura", "fig.", "table", "tabela", "tab.", "chart", "gráfico", "plot", "diagram", "diagrama",
)
CONCLUSION_WORDS = (
    "conclusion", "conclusão", "summary", "resumo", "key findings", "principais descobertas", "main results",
    "resultados principais", "implications", "implicações", "recommendations", "recomendações",
)
LITERATURE_WORDS = (
    "literature review", "revisão da literatura", "state of the art", "estado da arte", "previous work",
    "trabalhos anteriores", "related work", "trabalhos relacionados", "background", "contexto", "references",
    "referências",
)
PRIORITY_RULES = (
    rule("abstract", ABSTRACT_WORDS),
    rule("methodology", METHODOLOGY_WORDS),
    rule("results", RESULT_WORDS),
    rule("definition", DEFINITION_INDICATORS, DEFINITION_TERMS),
    rule("equation", EQUATION_WORDS),
    rule("figure_table", FIGURE_WORDS),
    rule("conclusion", CONCLUSION_WORDS),
    rule("literature", LITERATURE_WORDS),
)
PRIORITY_RULES_SECOND_LOADER = tuple(r for r in PRIORITY_RULES if r.label != "literature")

# ---- Fixed values: page type for training data. ----
PAGE_TYPE_RULES = (
    rule("abstract", ("abstract", "resumo", "summary", "síntese")),
    rule("definition", ("define", "definition", "definição", "conceito", "é definido")),
    rule("equation", ("=", "∂", "∆", "∫", "∑", "equation", "equação", "formula")),
    rule("example", ("example", "exemplo", "case study", "estudo de caso")),
    rule("discussion", ("discussion", "discussão", "analysis", "análise", "results", "resultados")),
)

# ---- Fixed values: question types. ----
EXPANSION_TYPES = (
    rule("definition", ("o que é", "definição", "significa", "conceito")),
    rule("process", ("como", "processo", "método", "procedimento")),
    rule("application", ("aplicação", "uso", "exemplo", "prática")),
)
FEEDBACK_TYPES = (
    rule("definition", ("o que é", "what is", "define", "definir")),
    rule("process", ("como", "how", "processo")),
    rule("comparison", ("compare", "diferença", "difference")),
    rule("evaluation", ("vantagem", "desvantagem", "advantage")),
    rule("example", ("exemplo", "example", "case")),
)
CRITIQUE_TYPES = (
    rule("definition", ("o que é", "what is", "define", "definição")),
    rule("process", ("como", "how", "method", "processo")),
    rule("explanation", ("por que", "why", "porque", "razão")),
    rule("selection", ("qual", "which", "que tipo")),
    rule("factual", ("onde", "where", "quando", "when")),
)
ROUTING_TYPES = (
    rule("definition", ("o que é", "what is", "defina", "define", "explique", "explain")),
    rule("procedural", ("como", "how", "processo", "process", "procedimento")),
    rule("comparison", ("diferença", "difference", "comparar", "compare", "vs", "versus")),
    rule("calculation", ("calcular", "calculate", "formula", "equação", "equation")),
)
QUESTION_WORDS = ("o que é", "como", "quando", "onde", "por que", "qual", "quais")

# ---- Fixed values: line-level section patterns and weights. ----
SECTION_PATTERNS = (
    ("title", (r"^[A-Z][^.!?]*$", r"^\d+\.\s+[A-Z].*", r"^[IVX]+\.\s+[A-Z].*")),
    ("abstract", (r"(?iU)\babstract\b", r"(?iU)\bresumo\b", r"(?iU)\bsummary\b")),
    ("introduction", (r"(?iU)\bintroduction\b", r"(?iU)\bintrodução\b", r"(?iU)\bintroducción\b")),
    ("methodology", (r"(?iU)\bmethodology\b", r"(?iU)\bmetodologia\b", r"(?iU)\bmethods\b", r"(?iU)\bmétodos\b")),
    ("results", (r"(?iU)\bresults\b", r"(?iU)\bresultados\b", r"(?iU)\bfindings\b")),
    ("conclusion", (r"(?iU)\bconclusion\b", r"(?iU)\bconclusão\b", r"(?iU)\bconclusiones\b")),
    ("equation", (r"\$.*\$", r"\\begin\{equation\}", r"Equation\s+\d+", r"(?iU)equação\s+\d+")),
    ("figure", (r"(?iU)figure\s+\d+", r"(?iU)figura\s+\d+", r"(?iU)fig\.\s+\d+")),
    ("table", (r"(?iU)table\s+\d+", r"(?iU)tabela\s+\d+", r"(?iU)tab\.\s+\d+")),
)
# Text that any match of the groups after the first contains, in lower case.
SECTION_HINTS = (
    "abstract", "resumo", "summary", "introdu", "method", "metodologia", "métodos", "result", "findings", "conclus",
    "$", "\\begin", "equation", "equação", "figur", "fig.", "tabl", "tabela", "tab.",
)
SECTION_IMPORTANCE = {
    "abstract": 1.5, "introduction": 1.2, "methodology": 1.3, "results": 1.4, "conclusion": 1.3, "equation": 1.6,
    "figure": 1.1, "table": 1.1, "title": 1.4, "body": 1.0,
}
DEFINITION_TERMS = ("definição", "definition", "conceito")
SECTION_BONUS = {
    "abstract": 0.3, "introduction": 0.1, "methodology": 0.2, "results": 0.25, "conclusion": 0.2, "equation": 0.35,
    "title": 0.25,
}
BOUNDARY_PATTERNS = (
    r"^\d+\.\s*[A-ZÁÀÂÃÉÊÍÓÔÕÚÇ]",
    r"^[IVXLCDM]+\.\s*[A-ZÁÀÂÃÉÊÍÓÔÕÚÇ]",
    r"^[A-ZÁÀÂÃÉÊÍÓÔÕÚÇ][A-ZÁÀÂÃÉÊÍÓÔÕÚÇ\s]{8,}$",
    r"^\s*\d+\.\d+",
    r"^\s*(Abstract|Resumo|Introduction|Introdução|Methodology|Metodologia)s?\s*:?\s*$",
    r"^\s*(Results?|Resultados?|Conclusions?|Conclusões?)s?\s*:?\s*$",
    r"^\s*(Discussion|Discussão|References|Referências)s?\s*:?\s*$",
)

# ---- Fixed values: text repair. ----
GLUED_WORDS = (
    "de", "da", "do", "para", "com", "que", "entre", "são", "este", "essa", "esse", "uma", "volume", "poro", "modelo",
    "simulação", "análise",
)
CORRECTIONS = (
    ("quecaracterizam", "que caracterizam"), ("essesvolumes", "esses volumes"), ("deporos", "de poros"),
    ("entrepoços", "entre poços"), ("sãoparâmetros", "são parâmetros"), ("demodelo", "de modelo"),
    ("dosimulador", "do simulador"), ("parareservatório", "para reservatório"), ("dopoço", "do poço"),
    ("nafase", "na fase"), ("dopetróleo", "do petróleo"), ("narocha", "na rocha"), ("dapressão", "da pressão"),
    ("datemperatura", "da temperatura"), ("dapermeabilidade", "da permeabilidade"), ("daporosidade", "da porosidade"),
    ("dosaturation", "do saturation"), ("thepressure", "the pressure"), ("oilwater", "oil water"),
    ("gaswater", "gas water"),
)
ALLOWED_SYMBOLS = r"\-.,;:!?()\[\]{}/%$#@&*+=<>|~`^\"'≤≥≠∞∂∇±×÷°"

# ---- Fixed values: vocabularies. ----
FEEDBACK_TERMS = (
    "insim", "permeabilidade", "permeability", "simulação", "simulation", "reservatório", "reservoir",
    "waterflooding", "eclipse", "cmg",
)
COMPLEXITY_TERMS = ("insim", "simulação", "modelo", "permeabilidade")
KEY_TERM_STOP_WORDS = (
    "o", "que", "é", "como", "qual", "onde", "quando", "por", "para", "de", "da", "do", "em", "na", "no",
)
COMPRESSION_TERMS = (
    "insim", "insim-ft", "permeabilidade", "permeability", "porosidade", "porosity", "saturação", "saturation",
    "simulação", "simulation", "reservatório", "reservoir", "waterflooding", "injeção", "injection", "produção",
    "production", "eclipse", "cmg", "modelo", "model", "numérico", "numerical", "equação", "equation", "pressão",
    "pressure",
)
TRAINING_TERMS = (
    "insim", "eclipse", "cmg", "intersect", "tnavigator", "petrel", "streamlines", "simulation", "modeling",
    "numerical", "finite", "discretization", "grid", "timestep", "convergence", "iteration", "permeability",
    "porosity", "saturation", "compressibility", "viscosity", "density", "pressure", "temperature", "pvt", "relative",
    "capillary", "wettability", "heterogeneity", "production", "injection", "waterflooding", "breakthrough", "sweep",
    "efficiency", "recovery", "displacement", "mobility", "fractional", "flow", "cut", "gor", "wor", "bhp", "thp",
    "wellbore", "completion", "perforation", "skin", "productivity", "injectivity", "drawdown", "buildup",
    "interference", "connectivity", "eor", "ior", "wag", "surfactant", "polymer", "thermal", "steam", "sagd", "css",
    "chemical", "miscible", "immiscible", "carbonate", "sandstone", "shale", "tight", "unconventional", "naturally",
    "fractured", "dual", "vuggy", "reservatório", "simulação", "permeabilidade", "porosidade", "saturação",
    "produção", "injeção", "recuperação", "varrido",
)
HIGH_KEYWORDS = (
    "insim", "insim-ft", "permeabilidade", "permeability", "porosidade", "porosity", "simulação", "simulation",
    "reservatório", "reservoir", "petróleo", "oil",
)
MEDIUM_KEYWORDS = (
    "fluxo", "flow", "pressão", "pressure", "saturação", "saturation", "viscosidade", "viscosity", "densidade",
    "density",
)
NON_NAME_WORDS = (
    "abstract", "introduction", "conclusion", "results", "discussion", "references", "acknowledgements", "university",
    "institute", "department", "school", "faculty", "college", "laboratory", "center", "centre", "journal",
    "proceedings", "conference", "symposium", "workshop", "volume", "number", "edition", "chapter", "section",
    "appendix", "figure", "table", "equation", "theorem", "proof", "example", "january", "february", "march", "april",
    "june", "july", "august", "september", "october", "november", "december", "janeiro", "fevereiro", "março",
    "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro",
)
PLACEHOLDERS = ("unknown", "none", "n/a", "untitled", "author")
QUESTION_TEMPLATES = (
    "O que é {}?", "Como funciona {}?", "Qual a importância de {}?", "Explique o conceito de {}",
    "Descreva o processo de {}", "What is {}?", "How does {} work?", "Explain the concept of {}",
    "Describe the process of {}",
)

# ---- Fixed values: query expansion. ----
EXPANSION_TEMPLATES = {
    "definition": (
        "o que é {term}", "definição de {term}", "conceito de {term}", "{term} significado", "explicação {term}",
    ),
    "technical": (
        "{term} engenharia reservatórios", "{term} petróleo", "{term} simulação", "como calcular {term}",
        "fórmula {term}",
    ),
    "process": ("como {term}", "processo {term}", "método {term}", "procedimento {term}", "técnica {term}"),
    "application": ("{term} aplicação", "uso de {term}", "{term} na prática", "exemplo {term}", "caso {term}"),
}
EXPANSION_SYNONYMS = {
    "permeabilidade": ("k", "perm", "condutividade hidráulica", "facilidade de fluxo"),
    "porosidade": ("phi", "φ", "espaço poroso", "volume de poros"),
    "saturação": ("sw", "so", "sg", "saturation"),
    "viscosidade": ("mu", "μ", "viscosity"),
    "simulação": ("modeling", "modelo", "simulation"),
    "reservatório": ("reservoir", "jazida"),
    "insim": ("INSIM-FT", "interwell simulation", "simulação interpoços"),
    "pressão": ("pressure", "p"),
    "densidade": ("density", "rho", "ρ"),
    "fluxo": ("flow", "vazão", "rate"),
    "produção": ("production", "recovery", "extração"),
}
CONTEXT_DOMAINS = ("petróleo", "reservatório", "engenharia")
CONTEXT_SUFFIXES = (" petróleo", " engenharia reservatórios")
SIMULATION_WORDS = ("insim", "modelo", "simulação")
SIMULATION_SUFFIX = " simulador"

# ---- Fixed values: bilingual query optimiser. ----
OPTIMISER_SYNONYMS = {
    "insim": ("INSIM", "INSIM-FT", "INSIM-FT-3D", "Interwell Numerical Simulation", "Fast Track"),
    "insim-ft": ("INSIM", "INSIM-FT-3D", "Interwell Numerical Simulation Fast Track", "simulação interpoços"),
    "eclipse": ("ECLIPSE", "Schlumberger Eclipse", "simulador Eclipse", "reservoir simulator"),
    "cmg": ("CMG", "Computer Modelling Group", "IMEX", "STARS", "GEM"),
    "permeabilidade": ("permeability", "k", "conductividade hidráulica", "facilidade de fluxo", "perm"),
    "permeability": ("permeabilidade", "k", "hydraulic conductivity", "flow capacity"),
    "porosidade": ("porosity", "phi", "φ", "espaço poroso", "volume de poros"),
    "porosity": ("porosidade", "phi", "φ", "pore space", "pore volume"),
    "saturação": ("saturation", "sw", "so", "sg", "saturação de água", "saturação de óleo"),
    "saturation": ("saturação", "sw", "so", "sg", "water saturation", "oil saturation"),
    "viscosidade": ("viscosity", "mu", "μ", "resistência ao fluxo"),
    "viscosity": ("viscosidade", "mu", "μ", "flow resistance"),
    "densidade": ("density", "rho", "ρ", "peso específico", "massa específica"),
    "density": ("densidade", "rho", "ρ", "specific weight", "specific mass"),
    "compressibilidade": ("compressibility", "expansibilidade", "compressão"),
    "compressibility": ("compressibilidade", "expansion", "compression"),
    "simulador": ("simulator", "modelo numérico", "software de simulação", "numerical model"),
    "simulator": ("simulador", "numerical model", "simulation software"),
    "grid": ("malha", "mesh", "células", "discretização", "gridding"),
    "malha": ("grid", "mesh", "células", "discretização", "gridding"),
    "timestep": ("passo de tempo", "dt", "incremento temporal", "time increment"),
    "passo de tempo": ("timestep", "dt", "time increment", "temporal step"),
    "poço": ("well", "wellbore", "furo", "perfuração"),
    "well": ("poço", "wellbore", "borehole", "hole"),
    "produção": ("production", "extração", "recuperação", "producing"),
    "production": ("produção", "extraction", "recovery", "producing"),
    "injeção": ("injection", "injetor", "injetividade", "injector"),
    "injection": ("injeção", "injector", "injectivity"),
    "óleo": ("oil", "petróleo", "crude", "hidrocarboneto líquido", "petroleum"),
    "oil": ("óleo", "petróleo", "crude", "liquid hydrocarbon", "petroleum"),
    "gás": ("gas", "hidrocarboneto gasoso", "fase gasosa", "natural gas"),
    "gas": ("gás", "gaseous hydrocarbon", "gas phase", "natural gas"),
    "água": ("water", "fase aquosa", "salmoura", "brine", "aqueous phase"),
    "water": ("água", "aqueous phase", "brine"),
    "pvt": ("PVT", "propriedades pvt", "pressure volume temperature", "análise pvt"),
    "material balance": ("balanço de materiais", "balanço material", "equação de balanço", "material balance equation"),
    "balanço de materiais": ("material balance", "material balance equation", "mass balance"),
    "decline curve": ("curva de declínio", "análise de declínio", "declínio de produção", "decline analysis"),
    "curva de declínio": ("decline curve", "decline analysis", "production decline"),
    "recovery factor": ("fator de recuperação", "fr", "eficiência de recuperação", "recovery efficiency"),
    "fator de recuperação": ("recovery factor", "rf", "recovery efficiency"),
    "md": ("milidarcy", "millidarcy", "permeabilidade", "permeability unit"),
    "cp": ("centipoise", "viscosidade", "viscosity unit"),
    "bbl": ("barrel", "barril", "volume unit"),
    "scf": ("standard cubic feet", "pé cúbico padrão", "gas volume"),
    "psi": ("pounds per square inch", "libra por polegada quadrada", "pressure unit"),
    "bar": ("bar pressure", "pressão em bar", "pressure unit"),
}
OPTIMISER_CONTEXTS = {
    "darcy": "lei de darcy fluxo permeabilidade",
    "buckley": "buckley leverett frente de saturação",
    "black oil": "modelo black oil pvt simulação",
    "compositional": "modelo compositional equação de estado",
    "aquifer": "aquífero água connate influxo",
    "relative permeability": "permeabilidade relativa curvas kr",
    "capillary pressure": "pressão capilar pc saturação",
}
NUMBER_WITH_UNIT = r"\d+\s*(?:md|cp|bbl|scf|psi|bar|m³|m3|%)"
DEFINITION_QUESTION_WORDS = ("o que é", "qual")
EXPLANATION_QUESTION_WORD = "como"

# ---- Fixed values: acronyms and related concepts. ----
ACRONYMS = {
    "INSIM": "Interwell Numerical Simulation Model (INSIM) - Modelo de Simulação Numérica Interpoços",
    "INSIM-FT": "Interwell Numerical Simulation Model with Front Tracking (INSIM-FT) - Modelo INSIM com Rastreamento"
    " de Frente",
    "INSIM-FT-3D": "Interwell Numerical Simulation Model with Front Tracking in 3 Dimensions (INSIM-FT-3D) - Modelo"
    " INSIM com Rastreamento de Frente em 3 Dimensões",
    "FT": "Front Tracking - Rastreamento de Frente (técnica de simulação)",
    "PVT": "Pressure Volume Temperature (PVT) - Propriedades Pressão-Volume-Temperatura",
    "BHP": "Bottom Hole Pressure (BHP) - Pressão no Fundo do Poço",
    "WOR": "Water Oil Ratio (WOR) - Razão Água-Óleo",
    "GOR": "Gas Oil Ratio (GOR) - Razão Gás-Óleo",
    "ESP": "Electric Submersible Pump (ESP) - Bomba Centrífuga Submersa",
    "API": "American Petroleum Institute (API) - Instituto Americano de Petróleo",
    "SPE": "Society of Petroleum Engineers (SPE) - Sociedade dos Engenheiros de Petróleo",
    "ECLIPSE": "ECLIPSE - Simulador de Reservatórios da Schlumberger",
    "CMG": "Computer Modelling Group (CMG) - Grupo de Modelagem Computacional",
}
RELATED_CONCEPTS = {
    "insim": ("interwell", "numerical simulation", "reservoir modeling", "well connectivity"),
    "front tracking": ("insim-ft", "multiphase flow", "saturation front", "displacement"),
    "3d": ("three dimensional", "tridimensional", "spatial modeling", "grid"),
    "simulator": ("numerical model", "reservoir simulation", "flow modeling"),
    "interwell": ("between wells", "well connectivity", "tracer flow", "interference"),
}
MEANING_WORDS = ("significa", "sigla", "stands for", "acronym")
GAP_KEYWORD = "interwell"
DEFINITIONS_HEADING = "\n\n=== DEFINIÇÕES IMPORTANTES ===\n"
MEANING_INSTRUCTION = (
    "\n\n=== INSTRUÇÃO ESPECIAL ===\nO usuário está perguntando sobre o significado de uma sigla/acrônimo. Procure por"
    " definições explícitas ou expansões da sigla nos documentos acima."
)

# ---- Fixed values: enrichment before embedding. ----
EMBED_MAPPINGS = {
    "INSIM-FT": "INSIM FT Interwell Numerical Simulation Fast Track",
    "INSIM-FT-3D": "INSIM FT 3D Interwell Numerical Simulation Fast Track Three Dimensional",
    "PVT": "PVT Pressure Volume Temperature",
    "BHP": "BHP Bottom Hole Pressure",
    "WOR": "WOR Water Oil Ratio",
    "GOR": "GOR Gas Oil Ratio",
    "API": "API American Petroleum Institute",
    "SPE": "SPE Society of Petroleum Engineers",
    "permeabilidade absoluta": "absolute permeability permeabilidade",
    "permeabilidade relativa": "relative permeability permeabilidade",
    "fator de recuperação": "recovery factor recuperação",
    "simulação numérica": "numerical simulation simulação",
    "engenharia de reservatórios": "reservoir engineering engenharia",
    "análise de declínio": "decline curve analysis declínio",
    "mD": "milidarcy permeability",
    "cp": "centipoise viscosity",
    "bbl": "barrel volume",
    "scf": "standard cubic feet gas",
    "psi": "pounds per square inch pressure",
    "bar": "bar pressure",
}
EMBED_TERMS = (
    "permeabilidade", "porosidade", "saturação", "simulador", "reservatório", "poço", "produção", "injeção",
    "engenharia", "petróleo", "óleo", "gás", "insim", "eclipse", "cmg", "pvt", "material balance", "declínio",
    "permeability", "porosity", "saturation", "simulator", "reservoir", "well", "production", "injection",
    "engineering", "petroleum", "oil", "gas", "decline",
)
EMBED_PREFIX = "Reservoir engineering simulation petroleum: "
