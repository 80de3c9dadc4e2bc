"""Cue vocabularies."""

# The phrases that decide the results, as alternatives of case-insensitive expressions.
TITLE_KEYWORDS = r"survey|surveys|review|reviews|overview|taxonomy|comparative study"
TITLE_TERMS = r"survey|surveys|review|reviews|tutorial|overview|taxonomy|state[- ]of[- ]the[- ]art|systematic mapping|primer|roadmap|comparative study|literature"
ABSTRACT_SURVEY = r"this (?:survey|review|tutorial|article reviews|paper reviews|paper surveys)|we (?:survey|review)|(?:comprehensive|systematic|extensive|holistic|thorough) (?:overview|survey|review|literature review)|we provide an overview|provides? an overview|literature review|open (?:research )?(?:issues|challenges)|future research directions|we (?:summarize|categorize|classify) (?:the )?existing"
ABSTRACT_RESEARCH = r"we propose|we develop|we design|we derive|we formulate|is proposed|are proposed|our (?:proposed|approach|method|scheme|framework|algorithm|results)|the proposed|(?:experimental|simulation|numerical) results|outperforms?|closed-form"
THIS_ARTICLE = r"this (?:article|magazine)"
SAMPLER_CUE = r"this (?:survey|review|tutorial|article reviews|paper reviews|paper surveys)|we (?:survey|review)|(?:comprehensive|systematic|extensive) (?:overview|survey|review)|we provide an overview|state[- ]of[- ]the[- ]art (?:research|approaches|techniques|solutions)|literature review|open (?:research )?(?:issues|challenges)|future research directions"
MAGAZINES = r"magazine|^ieee wireless communications$|^ieee network$|^getmobile|^ieee intelligent systems$|^communications of the acm$|^ieee internet computing$|^ieee pervasive computing$|^ieee multimedia$|^ieee micro$|^computer$|^ieee potentials$"
NON_PAPER_TYPES = r"book|book-chapter|booksection|editorial|erratum|paratext|peer-review|retraction|dissertation|supplementary-materials|news|letterandcomments|lettersandcomments|dataset|reference-entry|conference-abstract"
NON_PAPER_TITLES = r"guest editorial|editorial|erratum|corrigendum|masthead|table of contents|front cover|in memoriam|call for papers"
JUNK_TITLES = r"editorial|erratum|errata|corrigendum|correction to|corrections to|in memoriam|introduction to the special|special issue|reviewers|table of contents|front cover|call for papers|editor'?s note|message from|retraction"
TITLE_TOOL_PHRASES = r"survey|review|directions|challenges|trends|approaches|opportunities|concepts|roadmap|Advances in|Analysis of"
STRICT_PHRASES = (
    "literature review|literature survey|literature study|literature analysis|comparative review|comparative survey|comparative study|comparative analysis|"
    "bibliographic review|bibliographic survey|bibliographic study|bibliographic analysis|bibliometric review|bibliometric survey|bibliometric study|bibliometric analysis|"
    "scientometric review|scientometric survey|scientometric study|scientometric analysis|systematic review|systematic survey|systematic study|systematic analysis|"
    "systematic literature review|systematic literature survey|systematic literature study|systematic literature analysis|meta analysis|meta review|meta study|"
    "meta-analysis|meta-review|meta-study|mapping study|systematic mapping|emerging trends|comprehensive survey|contemporary survey|systematization of knowledge|"
    "systematisation of knowledge|tutorial|review of|research directions|a review|case studies|overview of|summary of"
)
REVIEW_VENUES = r"review|survey|trends in"
REVIEW_TYPES = r"review|meta-?analysis"

# One of these at least is in all that the expression of that name matches.
ABSTRACT_SURVEY_STEMS = ("view", "survey", "tutorial", "open ", "future research", "existing")
ABSTRACT_RESEARCH_STEMS = ("propose", "we de", "we formulate", "outperform", "closed-form", " results", "our approach", "our method", "our scheme", "our framework", "our algorithm")
THIS_ARTICLE_STEMS = ("this article", "this magazine")

# What is cut from titles and abstracts, in this order, and from the builder's records.
CUT_MARKUP = (r"(?s)<tex-math.*?</tex-math>", r"<[^>]+>", r"\$[^$]*\$", r"\\[a-zA-Z]+\*?(?:\{[^}]*\})?", r"[{}\[\]]")
MARKUP = r"[<$\\{}\[\]]"  # one of these is in all that CUT_MARKUP cuts
CUT_TAGS = r"<[^>]+>"
CUT_HEADING = r"^\s*abstract[:.\s-]*"
CUT_NOTICE = r"(©|\(c\)|copyright).*$"

# Abstracts of fewer words are missing, leave a paper out of the sample, or out of the training set.
MIN_WORDS_MISSING, MIN_WORDS_SAMPLE, MIN_WORDS_TRAIN = 10, 30, 50


def word_bound(alternatives: str) -> str:
    return rf"\b(?:{alternatives})\b"
