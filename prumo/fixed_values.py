"""Fixed values that decide results: statuses, thresholds, word lists, formats."""

# Quotation statuses, best first.
VERIFIED = "verificada"
CORRECTED = "corrigida"
APPROXIMATE = "aproximada"
NOT_FOUND = "nao_encontrada"
SUPPORTED_STATUSES = (VERIFIED, CORRECTED, APPROXIMATE)

# Work states of tender details and documents.
PENDING = "pendente"
DONE = "ok"
FAILED = "falhou"
UNSUPPORTED = "nao_suportado"

# Quotation checking.
MIN_FRAGMENT = 12
APPROXIMATE_RATIO = 90.0

# Documents that carry rules, deadlines and specifications: notice, terms of
# reference, basic project.
READABLE_TYPES = (2, 4, 6)
MAX_ATTEMPTS = 5
MAX_ERROR = 1000
MAX_TITLE = 500
MAX_FILE_NAME = 300
MAX_DOCUMENT_BYTES = 40 * 2**20

# Extraction.
CHUNK_CHARS = 3000
MIN_CHARS_PER_PAGE = 80
MAX_UNPACKED = 300 * 2**20
MAX_ARCHIVE_DEPTH = 2

# Triage.
BATCH_SIZE = 20
RELEVANT_SCORE = 60
MAX_OBJECT = 700
CANDIDATE_LIMIT = 200

# Search and reading.
SEARCH_LIMIT = 6
PAGE_TEXT_LIMIT = 8000
ITEM_LIMIT = 80
ITEM_DESCRIPTION = 200
PROMPT_ITEMS = 40
PROMPT_ITEM_DESCRIPTION = 160

# Question intake.
HISTORY_TURNS = 6
QUESTION_MIN, QUESTION_MAX, TURN_MAX = 3, 500, 4000
CLIENT_MAX, CLIENT_WINDOW_SECONDS = 5, 600
DAILY_CAP = 40

SOURCE_ZONE = "America/Sao_Paulo"

# Enumerations of the analysis result.
SME_EXCLUSIVE = ("sim", "nao", "parcial", "nao_informado")
REQUIREMENT_CATEGORIES = (
    "habilitacao_juridica",
    "regularidade_fiscal_trabalhista",
    "qualificacao_economico_financeira",
    "qualificacao_tecnica",
    "outra",
)
REQUIREMENT_STATES = ("atende", "falta", "verificar")
CONDITION_KINDS = ("entrega", "amostra", "garantia", "pagamento", "vigencia", "outra")
SEVERITIES = ("baixa", "media", "alta")
RECOMMENDATIONS = ("participar", "avaliar", "nao_participar")

# Words that stay in lower case inside a proper name.
NAME_PARTICLES = ("de", "da", "do", "das", "dos", "e")

# Stopwords of the published Portuguese Snowball list.
STOPWORDS_PT = frozenset(
    """
    de a o que e do da em um para com não uma os no se na por mais as dos como mas ao ele das à
    seu sua ou quando muito nos já eu também só pelo pela até isso ela entre depois sem mesmo aos
    seus quem nas me esse eles você essa num nem suas meu às minha numa pelos elas qual nós lhe
    deles essas esses pelas este dele tu te vocês vos lhes meus minhas teu tua teus tuas nosso
    nossa nossos nossas dela delas esta estes estas aquele aquela aqueles aquelas isto aquilo
    estou está estamos estão estive esteve estava estávamos estavam esteja estejamos estejam
    hei há havemos hão houve haja hajamos hajam houverei houverá houveremos houverão houveria
    houveríamos houveriam
    sou somos são era éramos eram fui foi fomos foram fora fôramos seja sejamos sejam fosse
    fôssemos fossem for formos forem serei será seremos serão seria seríamos seriam
    tenho tem temos tém tinha tínhamos tinham tive teve tenha tenhamos tenham terei terá teremos
    terão teria teríamos teriam
    """.split()
) | frozenset(  # the regular past and future subjunctive forms of three of those verbs
    stem + ending
    for stem in ("estiv", "houv", "tiv")
    for ending in "emos eram era éramos esse éssemos essem er ermos erem".split()
)
