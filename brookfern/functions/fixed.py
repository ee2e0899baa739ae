"""Word lists, patterns and constants that results depend on.  All are plain data."""

# Stop words and marker lists of the retrieval and memory functions.
MEANINGFUL_STOPS = ["what", "does", "review", "sora", "with", "from", "that", "this", "into", "their", "about", "core", "model", "use"]
FOCUS_GENERIC = ["what", "which", "from", "paper", "document", "key", "feature", "features", "main", "some", "tell", "about", "explain", "describe", "according", "review", "use", "uses", "using", "docker"]
PHRASE_GENERIC = ["what", "which", "from", "paper", "document", "article", "key", "features", "main", "some", "tell", "about", "explain", "describe", "according", "review", "how", "why", "does", "used"]
ROUTING_STOPS = ["a", "an", "the", "and", "or", "but", "if", "then", "is", "are", "was", "were", "be", "been", "being", "what", "which", "who", "how", "why", "when", "where", "does", "do", "did", "of", "in", "on", "at", "by", "for", "with", "about", "to", "from", "into", "through", "that", "this", "these", "those", "it", "its", "they", "them", "their", "article", "paper", "document", "review", "give", "gives", "mean", "means", "included", "include", "useful", "help", "helps", "according", "first", "main", "key", "some", "tell", "explain", "describe", "recommend", "recommends", "steps", "step"]
MEMORY_STOPS = ["the", "and", "for", "with", "that", "this", "what", "how", "why", "are", "you", "your", "our", "from", "into", "about", "need", "should", "please", "kindly"]
MEMORY_SIGNALS = ["remember", "keep in mind", "do not", "don't", "dont", "never", "always", "we need", "we should", "target", "goal", "next step", "completed", "issue", "bug", "score", "eval", "benchmark"]
SENSITIVE_WORDS = ["password", "secret", "api key", "apikey", "token", "private key"]
LEAK_MARKERS = ["[child chunk", "title:", "section:", "page:", "score:", "retrieved chunk:", "chunk_id", "hybrid_score", "reranker_score", "follow publication", "get an email whenever", "by signing up"]
CASUAL = ["hi", "hello", "hey", "hola", "bonjour", "guten tag", "namaste", "namaskar", "how are you", "how are you doing", "how are you today", "what's up", "thanks", "thank you", "thank you so much", "bye", "goodbye", "see you", "see you later", "lol", "haha", "hehe", "what is your name", "who are you", "what can you do", "what can you do for me", "are you a bot", "are you an ai", "good morning", "good afternoon", "good evening"]
SENSITIVE_FILES = [".env", "credentials", "credentials.json", "id_dsa", "id_ecdsa", "id_ed25519", "id_rsa", "secrets.json"]
SENSITIVE_SUFFIXES = [".key", ".p12", ".pem", ".pfx"]
BROAD_MARKERS = ["### overview", "### introduction", "### applications", "### conclusion", "summary of"]

# Patterns of boilerplate lines, and of those that end a page.
BOILERPLATE = [r"^https?://", r"https?://\S+", r"^\d{1,2}/\d{1,2}/\d{2,4},\s+\d{1,2}:\d{2}\s+[AP]M\b", r"^\d+\s*/\s*\d+$", r"^member-only story\b", r"^listen\s+share\s+more\b", r"^follow$", r"^responses?\s*\(\d+\)$", r"^see all from\b", r"^more from\b", r"^recommended from medium\b", r"^read next:?$", r"^photo by\b", r"^image by\b", r"^published in\b", r"^open in app$", r"^search$", r"^previous$", r"^written by\b", r"^in by$", r"^subscribe\b", r"^upgrade to paid\b", r"^before you go:?$", r"^further reads?:?$", r"^see more recommendations\b", r"^create your own chatbot\b", r"^\d+\s+min read\b", r"^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\s+\d{1,2}\b", r"^thank you for being a part of the community\b"]
TERMINAL = [r"^no responses yet$", r"^responses?\s*(\(\d+\))?$", r"^read next:?$", r"^more from\b", r"^recommended from\b", r"^see more recommendations\b", r"^before you go:?$", r"^further reads?:?$"]

# Patterns and replacements of redaction, in order.
REDACTIONS = [
    (r"\b(?:sk|pk|ghp|gho|hf)_[A-Za-z0-9_=-]{8,}\b", "[REDACTED_SECRET]"),
    (r"(?i)\b(api key|apikey|token|password|secret|private key)\s*(?:is|=|:)\s*\S+", "$1 is [REDACTED_SECRET]"),
    (r"\b[A-Fa-f0-9]{32,}\b", "[REDACTED_SECRET]"),
    (r"\b[\w.+-]+@[\w.-]+\.[a-zA-Z]{2,}\b", "[REDACTED_EMAIL]"),
    (r"\b(?:\+?\d[\s-]?){9,}\b", "[REDACTED_PHONE]"),
]
SENSITIVE = [r"\b[\w.+-]+@[\w.-]+\.[a-zA-Z]{2,}\b", r"\b(?:\+?\d[\s-]?){9,}\b", r"\b(?:sk|pk|ghp|gho|hf)_[A-Za-z0-9_=-]{16,}\b", r"\b[A-Fa-f0-9]{32,}\b"]

# Constants of ranking.
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
RRF_K = 60

# Stop words of routing phrases and distinctive terms, and of the query rewriter.
ROUTE_PHRASE_STOPS = ["what", "which", "does", "article", "included", "include", "recommend", "according", "first", "steps", "step", "the", "and", "for", "with", "from", "into", "that", "this", "about", "why", "how", "are", "is"]
DISTINCTIVE_STOPS = ["what", "which", "who", "how", "why", "when", "where", "does", "article", "paper", "document", "review", "first", "main", "key", "steps", "step"]
REWRITE_STOPS = ["a", "an", "the", "and", "or", "but", "if", "then", "is", "are", "was", "were", "be", "been", "what", "which", "who", "how", "why", "when", "where", "of", "in", "on", "at", "by", "for", "with", "about", "to", "from", "into", "through", "does", "do", "did"]
SECTION_STOPS = ["what", "does", "review", "sora", "with", "from", "that", "this", "into", "their", "about"]
# Fixed value: a challenge of so many days, or to practise, is no limitation.
PRACTICE_CHALLENGE = r"\b\d+\s*[- ]?\s*day\s+[^?]*challenge\b|\bpractice\w*\s+[^?]*challenge\b"

# Words that name an intent of a query, and the terms that a rewritten query gains for it.
REWRITE_INTENTS = [
    (["input", "prompt", "instruction", "query"], ["input", "prompt", "instruction", "user", "natural language", "text"]),
    (["applications", "areas", "use case", "uses"], ["applications", "use cases", "areas", "domains", "industries", "sectors", "examples"]),
    (["architecture", "framework", "component", "components", "core model"], ["architecture", "framework", "components", "module", "model", "mechanism"]),
    (["represent", "representation", "encode", "encoding", "before feeding", "model input"], ["representation", "encoding", "tokens", "patches", "latent", "compressed", "input", "encoder", "model"]),
    (["native", "size", "sizes", "resolution", "aspect ratio"], ["native", "duration", "resolution", "aspect ratio", "format", "composition", "framing", "crop", "resize"]),
    (["follow", "following", "detailed", "language", "understanding"], ["instruction", "following", "caption", "description", "fine-tune", "training", "prompt"]),
    (["limitation", "limitations", "risk", "weakness", "constraint"], ["limitations", "challenges", "constraints", "failure", "risk", "issue", "accuracy", "usage", "physical", "spatial", "temporal", "interaction", "access", "safety"]),
    (["different", "earlier", "previous", "compare", "compared"], ["different", "previous", "earlier", "compared", "unlike", "improvement"]),
    (["capability", "capabilities", "simulate", "simulation", "simulator", "ability"], ["capabilities", "ability", "simulate", "simulation", "environment", "world", "consistency", "coherence"]),
]

# Words that name an intent of a query, and the terms that evidence for it is expected to hold.
EVIDENCE_INTENTS = [
    (["input", "prompt", "instruction", "query"], ["input", "prompt", "instruction", "user", "text", "natural language"]),
    (["application", "applications", "areas", "use case", "uses"], ["application", "applications", "use case", "domain", "area", "industry", "sector"]),
    (["architecture", "framework", "component", "core model"], ["architecture", "framework", "component", "module", "mechanism"]),
    (["role", "roles", "agent", "agents"], ["role", "roles", "agent", "agents", "planning", "coding", "testing", "debugging", "documentation", "collaborate", "specialization"]),
    (["strength", "strengths", "advantage", "advantages", "benefit", "benefits"], ["strength", "strengths", "advantage", "advantages", "benefit", "benefits", "memory", "speed", "performance", "hardware", "efficient", "interpretable", "competitive"]),
    (["large number", "large numbers", "large integer", "large integers", "very large", "big number", "big numbers"], ["large", "number", "numbers", "integer", "integers", "big numbers", "automatically manages", "special data types", "int", "long", "memory", "dynamic", "dynamically", "allocates", "digits", "10**"]),
    (["formula", "part formula", "three-part", "three part"], ["formula", "part", "parts", "step", "steps", "component", "components", "hook", "highlight", "handoff"]),
    (["pipeline", "workflow", "processing app", "app flow"], ["pipeline", "workflow", "setup", "load", "input", "file", "url", "upload", "pdf", "image", "model", "load_model", "process", "processing", "generate", "output", "doctags", "document", "doctagsdocument", "doclingdocument", "export", "markdown", "html", "json", "download", "preview", "interface", "ui", "gradio"]),
    ([".env", "env file", "environment file", "environment variable", "environment variables"], [".env", "env file", "local development", "environment variables", "variables", "api key", "api keys", "tokens", "secrets", "database", "database url", "url of your database", "key : value", "key-value", "slow", "messy", "inconvenient", "private", "secure", "safe"]),
    (["command", "useful", "usefulness", "server"], ["command", "single command", "built-in", "http server", "web server", "start", "run", "useful", "test", "web applications", "share files", "local network", "third-party", "browser", "localhost"]),
    (["used for", "useful for", "purpose"], ["used for", "useful", "application", "applications", "probabilistic", "structured", "structured prediction", "prediction", "context", "independent", "independent predictions", "sequential", "sequential data", "sequence", "label", "labels", "named entity", "ner", "format"]),
    (["represent", "representation", "encode", "encoding", "before feeding", "model input"], ["representation", "encoding", "token", "patch", "spacetime", "latent", "compressed", "input", "visual representation", "encoder", "transformer", "diffusion", "diffusion transformer"]),
    (["native", "size", "sizes", "resolution", "aspect ratio"], ["native", "duration", "resolution", "aspect ratio", "format", "composition", "framing", "crop", "resize"]),
    (["follow", "following", "detailed", "language", "understanding"], ["instruction", "following", "caption", "description", "training", "fine-tune", "prompt"]),
    (["limitation", "limitations", "risk", "weakness", "constraint"], ["limitation", "challenge", "constraint", "failure", "risk", "issue", "accuracy", "usage"]),
    (["different", "earlier", "previous", "compare", "compared"], ["different", "previous", "earlier", "compared", "unlike", "improvement"]),
    (["capability", "capabilities", "simulate", "simulation", "simulator", "ability"], ["capability", "ability", "simulate", "simulation", "environment", "world", "consistency", "coherence"]),
]

# Words of a question (its terms) and what sentences that answer it are expected to hold.
TERM_INTENTS = [
    (["input", "prompt", "instruction"], ["input", "prompt", "instruction", "user", "text", "natural language"]),
    (["application", "applications", "areas", "uses"], ["application", "use", "domain", "area", "industry", "sector"]),
    (["architecture", "framework", "component", "components"], ["architecture", "framework", "component", "module", "mechanism"]),
    (["role", "roles", "agent", "agents"], ["role", "roles", "agent", "agents", "planning", "coding", "testing", "debugging", "documentation", "collaborate", "specialization"]),
    (["represent", "representation", "model", "input"], ["representation", "token", "patch", "latent", "compressed", "compressing", "input", "encoder", "model"]),
    (["kernel", "scalable", "scale", "methods"], ["kernel", "scalable", "large datasets", "computation", "computational", "expensive", "approximating", "feature", "feature space", "memory", "cost"]),
    (["advancements", "agents", "assistants", "coding", "tools"], ["language model", "foundation model", "multi-step reasoning", "reasoning", "integration", "development environment", "project structure", "codebase", "version control", "runtime information", "autonomy"]),
    (["pipeline", "processing", "app", "document"], ["pipeline", "file", "url", "local", "load", "model", "generate", "output", "export", "format", "download", "preview", "interface"]),
    (["large", "numbers", "integer", "integers"], ["large numbers", "large integers", "memory", "dynamic", "dynamically", "allocates"]),
    (["native", "sizes", "size", "resolution"], ["native", "duration", "resolution", "aspect ratio", "composition", "framing", "crop", "resize"]),
    (["follow", "following", "instructions", "instruction", "detailed"], ["instruction", "following", "caption", "description", "training", "prompt"]),
    (["limitations", "limitation", "challenge", "constraints"], ["limitation", "challenge", "constraint", "failure", "risk", "issue", "accuracy", "usage"]),
    (["different", "earlier", "previous"], ["different", "previous", "earlier", "unlike", "improvement"]),
    (["capabilities", "capability", "simulate", "simulation", "simulator", "world"], ["capability", "ability", "simulate", "simulation", "physical", "digital", "environment", "environments", "scenario", "scenarios", "world", "consistency", "coherence", "example", "examples"]),
]

# What a question says (all groups, any of a group; several ways) and what sentences that answer it are expected to hold.
FACT_INTENTS = [
    ([[["used for", "useful"]]], ["used", "useful", "prediction", "structured", "context", "sequential", "sequence", "independent", "probabilistic", "application", "example", "label", "labels"]),
    ([[["best practice"]]], ["practice", "development", "analysis", "threshold", "notification", "schedule", "low-traffic", "multi-stage"]),
    ([[["indentation", "braces"]]], ["indentation", "enforces", "forces", "code block", "code blocks", "clean", "readable", "missing braces", "formatting", "readability"]),
    ([[["command", "server"], ["http", "web", "useful", "provide"]]], ["command", "http.server", "web server", "useful", "test", "web applications", "share files", "local network", "third-party", "browser", "localhost"]),
    ([[["limitation"]]], ["limitation", "challenge", "cause", "effect", "physical", "spatial", "placement", "arrangement", "temporal", "irrelevant", "interaction", "usage", "access", "safety"]),
    ([[["detect", "anomal"]]], ["detect", "isolate", "isolates", "outlier", "random", "randomly", "partitioned", "labeled", "unlabeled", "unsupervised", "abnormal", "rare", "unusual"]),
    ([[["strength"]]], ["strength", "memory", "speed", "performance", "hardware", "logic", "reward", "penalty", "interpretable"]),
    ([[["hardcod", "secret"]]], ["hardcode", "hardcoding", "secret", "secrets", "key", "keys", "database", "connection", "configuration", "settings", "structured", "safe"]),
    ([[[".env", "env file"], ["local", "development", "recommend"]]], [".env", "env file", "local development", "environment variables", "variables", "api keys", "tokens", "secrets", "database", "url", "key : value", "key-value", "slow", "messy", "inconvenient"]),
    ([[["start", "recommend", "steps"]]], ["skill", "tool", "tools", "faster", "draft", "research", "brainstorm", "package", "service", "client", "group", "fast", "try", "practice"]),
    ([[["pipeline", "processing app"]]], ["local", "url", "load", "model", "generate", "output", "document", "export", "format", "download", "preview", "interface"]),
    ([[["settings"], ["environment", "variables", "validate", "map"]]], ["settings", "class", "field", "default", "alias", "validation", "prefix", "validate", "environment variables"]),
    ([[["env.example", "gitignore"]]], ["private", "ignore", "never push", "repository", "developer", "placeholder", "placeholders", "keys"]),
    ([[["markup", "tag"]]], ["markup", "layout", "semantics", "reading order", "hierarchy", "parser", "heuristic", "downstream", "accuracy", "conversion"]),
    ([[["forgettable", "remember", "memorable", "intro"]]], ["predictable", "tune out", "brain", "name", "job", "hobby", "effect", "impression", "seconds", "science", "story", "curiosity", "attention", "question", "engage", "remember", "memorable"]),
    ([[["coding tools"]], [["tools"], ["strength"]]], ["tool", "tools", "context", "codebase", "multi-agent", "multiple files", "project", "consistency"]),
    ([[["multi-agent", "multi agent"]]], ["agent", "agents", "planning", "coding", "testing", "debugging", "documentation", "parallel processing", "specialization"]),
    ([[["brain"], ["science"]], [["formula"], ["works"]]], ["brain", "science", "surprise", "story", "stories", "feel", "emotional", "memory", "question"]),
    ([[["business", "client", "charge"]]], ["hours", "content", "business", "businesses", "outline", "outlines", "post", "posts", "email", "client", "clients", "work", "personal touch", "charge"]),
    ([[["hold"], ["back"]]], ["fear", "failing", "looking", "wasting", "time", "stuck", "job", "trying", "try", "barrier", "obstacle"]),
    ([[["replace"]]], ["tool", "tools", "faster", "income", "side income", "background", "technical", "tech", "degree", "code", "no code", "product", "app", "save time", "make money", "learn", "need", "don't need", "don\u2019t need", "didn't", "didn\u2019t"]),
]

# Markers of direct evidence for each shape of answer, and groups of markers of the stages of a pipeline.
DIRECT_MARKERS = {
    "definition": [" is a ", " is an ", " are a ", " are an ", " refers to ", " means ", " known as ", " called ", " defined as ", " released by ", " released in "],
    "limitation": ["limitation", "limitations", "challenge", "challenges", "constraint", "failure", "fails", "struggle", "issue", "risk", "cannot", "does not"],
    "list": ["include", "includes", "including", "features include", "key features", "strength", "strengths", "key strengths", "advantage", "advantages", "benefit", "benefits", "low memory", "high learning speed", "performance", "efficient", "interpretable", "consists of", "types", "steps", "roles", "roles like", "agents that", "planning agents", "coding agents", "testing agents", "debugging agents", "documentation agents", "components", "formula", "part formula", "hook", "highlight", "handoff", "collaborate", "specialization", "first", "then", "finally", "such as"],
    "mechanism": ["automatically manages", "large integers", "large numbers", "big numbers", "special data types", "int or long", "dynamically allocates", "allocates memory", "dynamic memory", "10**", "digits", "using", "uses", "through", "by ", "turn", "convert", "transform", "generate", "process", "pipeline", "model", "input", "output"],
    "explanation": ["because", "due to", "therefore", "as a result", "recommend", "recommended", "helps", "allows", "enables", "shows", "demonstrates", "capability", "ability", "local development", "environment variables", "api key", "api keys", "database url", "url of your database", "tokens", "secrets", "slow and messy", "inconvenient", "key : value", "key-value", "private", "secure", "safe"],
    "usage": ["used for", "useful for", "useful", "helps", "allows", "enables", "purpose", "application", "applications", "command", "single command", "built-in", "web server", "http server", "start one instantly", "quickly test", "test web applications", "share files", "local network", "third-party tools", "browser", "localhost", "serve files", "probabilistic", "structured prediction", "structured", "prediction", "independent predictions", "context", "sequential data", "sequential", "sequence", "label", "labels", "named entity", "ner"],
    "pipeline": ["pipeline", "workflow", "setup", "load", "input", "file", "upload", "url", "image", "pdf", "model", "load_model", "process", "processing", "generate", "output", "doctags", "markup", "document", "doctagsdocument", "doclingdocument", "export", "markdown", "html", "json", "download", "preview", "interface", "ui", "gradio"],
}
PIPELINE_STAGES = [["pdf", "image", "file", "upload", "url", "input"], ["model", "load_model", "load the"], ["process", "processing", "generate", "output", "doctags", "markup"], ["document", "doctagsdocument", "doclingdocument"], ["export", "markdown", "html", "json", "format"], ["preview", "download", "interface", "ui", "gradio"]]
LIST_CUE = r"\b(?:first steps?|do this first|start today|here'?s how|recommended?|suggests?)\b"
PREFILTER_MARKERS = ["include", "includes", "such as", "limitation", "challenge", "because", "roles", "agents", "strength", "strengths", "advantage", "advantages", "benefit", "benefits", "command", "single command", "built-in", "web server", "http server", "quickly test", "test web applications", "share files", "local network", "third-party tools", "browser", "localhost", "environment variables", "local development", "api key", "api keys", "tokens", "secrets", "database", "key : value", "slow and messy", "inconvenient", "structured prediction", "independent predictions", "sequential data", "named entity", "ner", "pipeline", "workflow", "setup", "load_model", "doctags", "doctagsdocument", "doclingdocument", "export", "markdown", "html", "json", "download", "preview", "gradio"]

# Markers of leaked context in answers before verification, and of unfocused answers.
ANSWER_LEAK_MARKERS = ["[child chunk", "retrieved chunk", "chunk_id", "hybrid_score", "reranker_score", "title:", "section:", "score:", "text:", "follow publication", "get an email whenever", "by signing up"]
LIST_STYLE = ["main message", "formula", "steps", "features", "best practices", "challenge"]
# Entities that may stand in an answer whatever was asked, and words that are no entities of a query.
GENERIC_ENTITIES = ["docker", "pdf", "api", "ai", "ml", "rag", "url", "http", "https", "monitoring", "detecting", "updating", "updates", "containers", "security", "stability", "overhead", "this", "these", "that", "those", "there", "their", "they", "development", "optimize", "configure", "wisely", "keep", "create", "start", "implement", "schedule", "use", "run", "set", "limitations", "limitation", "challenges", "challenge", "features", "feature", "capabilities", "capability", "applications", "application", "architecture", "framework", "components", "component", "physical", "digital", "visual", "language", "interaction", "human-computer", "openai"]
ENTITY_GENERIC = ["what", "which", "from", "paper", "document", "key", "feature", "features", "main", "some", "tell", "about", "explain", "describe", "according", "review"]
VERIFIER_STOPS = ["what", "which", "are", "does", "do", "did", "how", "why", "this", "that", "the", "and", "for", "from", "into", "with", "about", "according", "paper", "document", "article", "review", "describe", "discuss", "main", "some", "type", "uses", "used", "using", "make", "makes", "say", "user", "answer", "context", "retrieved", "section", "page"]
PUBLISHER_MARKERS = ["follow publication", "published in", "get an email", "by signing up"]

# Markers of sentences for the predicates of facts.
STRUCTURED = r"\b(?:\d+[.)]|day\s*\d+|step\s*\d+|first|second|third|finally)\b"
EXAMPLE_MARKERS = ["such as", "including", "includes", "for example", "e.g.", "like "]
HIGH_SIGNAL = ["is a", "released", "it has three parts", "(1)", "(2)", "(3)", "such as", "include", "including", "for example", "limitation", "challenge", "approach", "method", "capability", "useful", "why is", "enforces", "forces", "key : value"]
SHORT_SIGNAL = ["http.server", "quickly test", "share files", "local network", "third-party", "clean", "readable", "missing braces", "key : value", "api keys", "database", "degree", "computer science degree", "tech bro", "technical background", "line of code", "fancy app", "product", "don't need", "don’t need", "no code", "save time", "make money"]
CODE_MARKERS = ["import ", "plt.", "np.", "print(", "pip install", "```", "def ", "elif ", "app.launch", "gr.", "tempfile.", "return gr.", "random_state", "train_test_split"]
CODE_QUERIES = ["command", "setup", "run", "install", "code", "example", "server", "large number", "numbers", "settings", "environment variables", "configuration"]
CODE_KEPT = ["pip ", "uv ", "install", "python", "print(", "**", "http", "localhost", "127.0.0.1", "load", "url", "alias", "prefix", "validation"]
AUTHOR_MARKERS = ["university", "research", "author", "corresponding", "email"]
BROAD_QUERIES = ["limitation", "challenge", "detect", "anomal", "useful", "scalable", "model input", "start", "pipeline", "formula", "architecture", "mentioned", "reasons", "command", "server", ".env", "env file", "indentation", "braces", "replace", "mean by", "simulate", "simulation", "simulator", "world"]
MOJIBAKE = [("â€™", "'"), ("â\u0080\u0099", "'"), ("â€˜", "'"), ("â\u0080\u0098", "'"), ("â€œ", '"'), ("â\u0080\u009c", '"'), ("â€�", '"'), ("â\u0080\u009d", '"'), ("â€“", "-"), ("â\u0080\u0093", "-"), ("â€”", "-"), ("â\u0080\u0094", "-"), ("â€¦", "..."), ("â\u0080¦", "..."), ("Â°", "°"), ("Â·", "-"), ("Â ", " "), ("Â", "")]
BROKEN_WORDS = [("simu- late", "simulate"), ("signif- icantly", "significantly"), ("gener- ation", "generation"), ("remain- ing", "remaining")]

# Words before the head of what a query asks for, and heads that ask for no definition.
DEFINITION_MODIFIERS = ["the", "a", "an", "its", "their", "this", "that", "these", "those", "key", "main", "core", "primary", "major", "special", "best", "different", "three", "two", "first", "recommended"]
NOT_DEFINED = ["application", "applications", "approach", "approaches", "benefit", "benefits", "capability", "capabilities", "challenge", "challenges", "command", "commands", "component", "components", "difference", "differences", "example", "examples", "feature", "features", "formula", "function", "functions", "kind", "kinds", "limitation", "limitations", "method", "methods", "part", "parts", "pipeline", "pipelines", "workflow", "workflows", "flow", "flows", "practice", "practices", "purpose", "reason", "reasons", "role", "roles", "step", "steps", "strength", "strengths", "tool", "tools", "type", "types", "use", "uses"]

# Categories of limitations and their markers, and groups of markers that a whole answer covers.
LIMITATION_CATEGORIES = [
    ("physical/cause-and-effect", ["cause", "effect", "physical", "plausibility", "rigid", "motion"]),
    ("spatial", ["spatial", "placement", "arrangement", "left", "right", "direction"]),
    ("temporal", ["temporal", "camera", "sequence", "flow"]),
    ("irrelevant entities", ["irrelevant", "unrelated", "animals", "people", "characters", "elements"]),
    ("human-computer interaction (HCI)", ["human-computer", "hci", "user-system", "user system", "interaction", "language instructions"]),
    ("usage/access", ["usage", "access", "release", "public", "safety", "one minute", "one-minute", "length"]),
]
LIMITATION_WORDS = ["limitation", "challenge", "failure", "constraint", "issue"]
LIMITATION_LABELS = [("spatial", ["spatial"], "Spatial limitation: "), ("human-computer interaction (HCI)", ["human-computer", "hci"], "Human-computer interaction (HCI) limitation: "), ("physical/cause-and-effect", ["cause"], "Physical/cause-and-effect limitation: "), ("irrelevant entities", ["irrelevant"], "Irrelevant-entity limitation: "), ("usage/access", ["usage"], "Usage/access limitation: ")]
LIMITATION_COVERAGE = [["cause", "effect", "physical", "plausibility", "rigid", "motion"], ["spatial", "placement", "arrangement", "left", "right"], ["temporal", "sequence", "camera"], ["irrelevant", "unrelated", "animals", "people", "characters", "objects"], ["human-computer", "hci", "user-system", "interaction"], ["usage", "access", "release", "public", "one minute", "one-minute", "longer content"]]
NUMBER_COVERAGE = [["large integer", "large number", "big number", "very large"], ["automatically manages", "automatically handle", "handles automatically"], ["special data type", "int or long", "separate int", "separate long"], ["dynamic memory", "dynamically allocates", "allocates memory"], ["10**", "100 digits", "digits"], ["use numbers normally", "numbers normally"]]
PIPELINE_COVERAGE = [["pdf", "image", "file", "url", "upload", "input"], ["load", "model"], ["generate", "process", "output", "doctags", "markup"], ["document", "doclingdocument", "doctagsdocument"], ["markdown", "html", "json", "export", "format"], ["preview", "download", "ui", "interface", "gradio"]]
SETUP_COVERAGE = [["uv venv", "python -m venv", "virtual environment"], ["activate"], ["pip install", "uv pip install", "npm install", "poetry add", "conda install"], ["brew install", "apt install", "system package"], ["uv run", "python ", "npm run", "poetry run"]]
FORMULA_PARTS = ["hook", "highlight", "handoff", "part", "step", "component", "framework"]
RELATIONS = [" is ", " are ", "refers to", "means", "called", "known as"]
LIST_FOCUS = ["feature", "features", "strength", "strengths", "advantage", "advantages", "benefit", "benefits", "role", "roles", "component", "components"]
LIST_DETAILS = ["feature", "strength", "advantage", "benefit", "role", "component", "memory", "speed", "efficient", "performance", "security", "stability", "monitor", "detect", "update", "supports", "allows", "helps"]
COMMAND = r"(?i)\b(?:python\s+-m\s+[-\w.]+(?:\s+\d+)?|docker\s+run\b|pip\s+install\b|uv\s+run\b|npm\s+install\b|brew\s+install\b)"
COMMAND_QUERY = r"\bcommands?\b|\bsetup\b|\binstall(?:ation)?\b|\brun(?:ning)?\b|\bserver\b|\bhow\s+(?:do|can|to)\s+(?:i\s+)?(?:start|run|install|set\s+up)\b|\bstart(?:s|ed|ing)?\s+(?:the\s+)?(?:server|app|application|container|service|tool)\b"
COMMAND_USES = ["useful", "test", "web application", "web server", "http server", "share", "local network", "browser", "localhost"]
PRACTICE_MARKERS = ["practice", "mirror", "friend", "feedback", "real life"]
NOT_NAMES = ["The", "Article", "Tools", "Docker", "Medium", "AWS"]

# Spellings of words for tables that a plan understands, and paths of files in a question.
TABLE_SPELLINGS = [("data base", "database"), ("data-base", "database"), ("databse", "database"), ("datbase", "database"), ("sql lite", "sqlite"), ("sqlite3", "sqlite")]
FILE_PATH = r"([A-Za-z0-9_.-]+\.(?:cfg|csv|ini|json|log|md|py|ps1|toml|txt|yaml|yml))"

# Source windows.  Words of questions, cues of texts, ends of excerpts, patterns and notes.
WINDOW_QUERIES = ["feature", "analy", "setup", "commands", "reason", "formula", "example", "large number", "large integer", "very large", "main message", "author do", "what does the author", "holding", "holds", "hold people back"]
WINDOW_STOPS = ["what", "which", "are", "does", "do", "did", "how", "why", "the", "and", "for", "with", "from", "into", "about", "according", "review", "paper", "document", "article", "discuss", "describe", "say", "use", "uses", "used", "make", "makes", "key", "feature", "features", "machine", "learning"]
WINDOW_REASON_CUES = ["why this works", "brain science", "reason", "reasons", "because", "triggers", "activate", "remember", "question"]
WINDOW_REASON_STRONG = ["why this works", "brain science"]
WINDOW_REASON_MARKS = ["triggers", "activate", "feel", "remember", "question"]
WINDOW_HOLDING_CUES = ["stuck because", "fear", "failing", "looking", "wasting", "trying", "try"]
WINDOW_HOLDING_MARKS = ["stuck because", "fear", "failing", "looking", "wasting"]
WINDOW_HOLDING_TRIES = ["try", "trying"]
WINDOW_MESSAGE_GROUPS = [["quit", "quitting"], ["risk", "burn"], ["paycheck"], ["hours a day", "hours"]]
WINDOW_MESSAGE_MARKS = ["quit", "risk", "burn", "paycheck", "hours"]
WINDOW_GENERIC_MARKS = ["because", "here's what", "what i do", "fear", "wasting", "memory", "digits", "paycheck", "quit your job", "risk everything", "burn", "hours a day"]
WINDOW_HOLDING_TERMS = ["back", "fear", "stuck"]
WINDOW_QUIT_TERMS = ["quit", "risk", "burn", "paycheck", "hours"]
WINDOW_LARGE_TERMS = ["large", "numbers", "integers", "memory", "digits"]
WINDOW_AUTHOR_TERMS = ["here", "use", "clients", "charge", "work"]
WINDOW_FORMULA_ENDS = ["example", "challenge", "your 7-day", "tag ", "follow publication", "published in"]
WINDOW_FORMULA_ASIDES = ["challenge", "tag ", "clap ", "follow publication", "published in"]
WINDOW_FORMULA_PART = r"\b(?:\d+|one|two|three|four|five|six|seven|eight|nine|ten)[-\s]*part\s+formula\b"
WINDOW_FORMULA_ITEM = r"(?<!\d)\b(\d{1,2})\.\s+(?=(?:the\s+)?[A-Z][A-Za-z0-9\"'() /-]{1,90}:)"
WINDOW_FORMULA_TAIL = r"(?i)\b(?:bad|better|example|challenge|result|tag|follow|published in)\s*:"
WINDOW_EXAMPLE_ENDS = ["challenge", "why this works", "tag "]
WINDOW_FEATURE_MARKS = ["feature", "include", "capability", "support", "supports", "provides", "offers", "allows", "enables", "helps", "automatic", "interactive"]
WINDOW_FEATURE_CUES = ["features include", "key features"]
WINDOW_FEATURE_STARTS = ["features include", "key features", "what is", "analy"]
WINDOW_FEATURE_ENDS = [
    "getting started", "how to use", "how do i", "pro tip", "you can try", "when using", "best practices", "why these tools matter", "setup instructions", "complete code", "installation", "installing", "resources", "references",
    "try it out", "start integrating", "thanks for reading", "get an email", "signing up", "final thoughts", "let's connect", "lets connect", "connect!", "embrace ",
]
WINDOW_COMMAND_TEXT = ["docker run", "brew install", "pip install", "npm install", "conda install", "poetry add", "uv run", "python -m", "alias ", "git clone"]
WINDOW_SOCIAL_TEXT = ["start integrating", "thanks for reading", "get an email", "signing up", "follow me on", "subscribe to", "your thoughts and feedback", "connect!"]
WINDOW_COMMAND_QUERIES = ["command", "setup", "install", "run", "how to use", "execute"]
WINDOW_COMMANDS = [
    r"\bpip\s+install\s+uv\b", r"\buv\s+venv\s+[-\w./]+", r"\bsource\s+[-\w./]+activate\b", r"\buv\s+pip\s+install\s+.+?(?=\s+brew\s+install|\s+Building\b|\s+Step\s+\d|\s+\d+[.)]\s+[A-Z]|$)",
    r"\bbrew\s+install\s+[-\w./]+", r"\buv\s+run\s+[-\w./]+(?:\.py)?", r"\bpython\s+-m\s+[-\w.]+(?:\s+\d+)?", r"\bnpm\s+(?:install|run)\s+[-\w./]+", r"\bpoetry\s+(?:add|run)\s+[-\w./]+",
]
WINDOW_PLATFORM_NOTE = "- The tutorial notes a Mac M1/M2/M3/M4 setup using MLX and Apple's Metal-accelerated backend."
WINDOW_LAUNCH_NOTE = "- The app launches with `app.launch()` and is run locally with Gradio's default server, normally `http://127.0.0.1:7860/`."
WINDOW_NUMBER_FACTS = {
    "integers": "Python automatically manages large integers.", "numbers": "Python automatically manages large numbers.", "types": "It does not require special data types for big numbers.", "kinds": "There is no need for separate int or long types.",
    "normal": "Developers can use numbers normally.", "memory": "Python dynamically allocates memory.", "power": "The article gives `10**100` as an example of a very large number.",
}
WINDOW_INTRO_CLASSES = ["tool", "interface", "ui", "model", "library", "framework", "method", "algorithm", "system", "service", "application", "platform"]
WINDOW_INTRO_RELATIONS = [" is ", " are ", "refers to", "means", "used for", "monitors", "analyzes", "automates", "helps", "allows", "enables"]
ENTITY_TERM_STOPS = ["a", "an", "the", "and", "or", "of", "for", "about", "by", "in", "on", "to"]
SUBJECT_QUERIES = [
    r"(?i)^\s*what\s+does\s+(.+?)\s+(?:help|support|provide|allow|enable|detect|analy[sz]e|monitor|update|show)\b",
    r"(?i)^\s*how\s+does\s+(.+?)\s+(?:help|work|support|provide|allow|enable|detect|analy[sz]e|monitor|update|show)\b",
]
WINDOW_FEATURE_REWRITES = [
    (r"^[^A-Za-z0-9]*(?:[-\\\w./:=<>]+\s+){2,}(?=What is|[A-Z][A-Za-z0-9_-]+:)", ""),
    (r"(?i)^what\s+is\s+[^?]{1,100}\?\s*", ""),
    (r"(?i)\b(?:some\s+(?:of\s+)?the\s+)?key\s+features(?:\s+of\s+[^:]{1,80})?\s+include:\s*", "Key features include: "),
    (r"(?i)(key\s+features\s+include:\s*){2,}", "Key features include: "),
    (r"\b(?:Follow|Published in)[^.!?]{0,120}", ""),
]
# Signs of texts that were read in the wrong encoding.
MOJIBAKE_MARKS = ["\u00e2", "\u00c2", "\u00c3", "\u0080", "\u0098", "\u0099", "\u009c", "\u009d"]

# Steps and pipelines.
STEP_ENDS = ["why this works", "brain science", "tag your", "follow for", "comment your", "drop your"]
STEP_QUERY_WORDS = ["step", "steps", "day", "practice"]
STEP_MARKS = ["day", "hook", "practice", "mirror", "friend", "feedback", "real life"]
DAY_STEPS = r"(?i)(?:^|\s)(?:\d+[.)]\s*)?((?:Day|Days)\s+\d+(?:\s*[-–—]\s*\d+)?\s*:\s*.*?)(?=\s+\d+[.)]\s*(?:Day|Days)\s+\d+|\s+Why\s+This\s+Works|\s+Brain\s+Science|$)"
NUMBERED_STEPS = r"(?i)(?:^|\s)\d+[.)]\s*(.*?)(?=\s+\d+[.)]\s+|\s+Why\s+This\s+Works|\s+Brain\s+Science|$)"
PIPELINE_QUERIES = ["pipeline", "workflow", "processing app", "app flow"]
PIPELINE_MARKERS = ["load", "input", "file", "url", "image", "pdf", "model", "process", "generate", "output", "document", "export", "download", "preview", "interface", "ui"]
PIPELINE_COMMENTS = ["load", "input", "process", "generate", "create", "export", "download", "preview"]
CONTENT_STOPS = ["what", "which", "does", "this", "that", "from", "with", "about", "paper", "document", "article", "answer", "context", "section", "page"]
ORDINALS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth"]

# The order in which answers replace and stand in for each other, greetings, and what is said where nothing answers.
REPLACED_ALWAYS = ["best_practices", "recommended_items", "capability", "limitation", "definition", "used_for", "config_file", "meaning", "pipeline", "challenge", "command"]
STANDS_IN = ["capability", "why", "definition", "used_for", "config_file", "meaning", "pipeline", "challenge", "command", "example", "source_window", "recommended_items", "list", "mechanism", "focused_entity", "best_practices", "limitation"]
REPAIRED_BY = ["source_window", "limitation", "definition", "used_for", "config_file", "meaning", "recommended_items", "pipeline", "command", "example", "why", "list", "mechanism", "focused_entity"]
NO_LIST_AFTER = ["best_practices", "recommended_items", "limitation", "used_for", "config_file", "meaning", "challenge", "command"]
PREFERRED_WINDOWS = ["feature", "analy", "setup", "commands", "reason", "formula", "example", "large number", "large integer", "very large", "main message", "author do", "what does the author", "holding", "holds"]
FOCUSED_QUERIES = ["used for", "key strength", "key strengths", "how do", "how does", "what is"]
SPECIFIC_STOPS = ["figure", "source", "section", "title", "page"]
GREETINGS = {w: f"{said}! How can I help you today?" for w, said in (("hi", "Hello"), ("hello", "Hello"), ("hey", "Hey"), ("namaste", "Namaste"), ("namaskar", "Namaskar"), ("good morning", "Good morning"), ("good afternoon", "Good afternoon"), ("good evening", "Good evening"))}
DIRECT_FALLBACK = "I'm here and ready to help. Could you rephrase your question?"
TOOL_FALLBACK = "The tool output does not directly answer this."

# Definitions.
DEFINED_BY = [" is ", " are ", "refers to", "means", "called", "known as"]
DEFINED_CLASSES = ["tool", "interface", "model", "library", "system", "helps", "allows"]
DEFINED_DETAILS = ["instead of", "interface", "features include", "view", "monitor", "helps", "allows", "trained", "generate", "creates", "created", "can ", "capable", "designed", "developed", "released", "supports", "used for"]
DEFINED_SCORES = {
    4: [" is ", " are ", "refers to", "means", "model", "tool", "library", "system", "framework", "algorithm", "method", "platform", "service"],
    2: ["interface", "helps", "allows", "released by", "released in", "developed by", "created by", "built by"],
    -8: ["compared to", "distinguished by", "previous video", "previous model"],
}
DEFINED_ENDS = r"\bGetting Started\b|\bHow to use\b"

# Questions whose answers may not turn to another topic, and headings that are no topic.
TOPIC_QUERIES = ["feature", "capability", "capabilities", "strength", "advantage", "benefit", "role", "component"]
TOPIC_GENERIC = ["key", "main", "feature", "features", "benefit", "benefits", "strength", "strengths", "limitation", "limitations", "overview", "introduction", "conclusion", "summary", "getting", "started", "when", "use", "normal", "data", "some", "outliers", "anomalies", "monitoring", "detecting", "updating", "installation", "usage", "setup", "configuration"]
