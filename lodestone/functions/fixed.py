"""Fixed values. Results depend on every one of them, so they are stated plainly."""

HOST = "https://github.com/"

# How the first positive dependency source is scaled.
CARGO_SCALE = 0.30
GO_SCALE = 0.40
MAVEN_SCALE = 0.80

# Dependency counts assumed for projects where no source finds any.
PROXY_COUNTS = {
    "libBLS": 50,
    "mcl": 50,
    "blst": 20,
    "nimbus-eth2": 400,
    "DAppNode": 5,
    "simple-optimism-node": 3,
    "ethereum-helm-charts": 5,
    "ethereum-package": 5,
    "libp2p": 0,
}

# Ages in years.
AGE_UNKNOWN = 1.0
AGE_NO_COLUMN = 3.0
AGE_FLOOR = 0.1
AGE_CAP = 7.0

# README phrases of technical depth, and of packaging work.
README_HIGH = [
    "bls12-381", "stark", "snark", "plonk", "polynomial", "commitment scheme",
    "zero-knowledge", "zk", "cryptographic", "signature library", "elliptic curve",
    "field arithmetic", "prime field", "zkvm", "proving", "verifier", "circuit",
    "compiler", "language", "specification language", "formal", "type system",
    "bytecode", "evm bytecode", "smart contract language",
    "execution client", "consensus client", "ethereum protocol", "beacon chain",
    "ethereum node", "full node", "implementation of", "virtual machine",
    "rollup", "layer 2", "proof system", "assembly",
]
README_LOW = [
    "docker", "helm", "kubernetes", "yaml", "configuration", "deployment",
    "run ethereum", "node setup", "easy to", "simple way", "quick start",
    "toolkit", "scaffold", "template", "boilerplate", "starter kit",
    "getting started", "built with", "powered by",
    "list of", "set of", "collection of", "registry", "chain id",
]
README_RANGE = (-3, 5)
EXCERPT_MIN = 80
EXCERPT_LEN = 800

# Phrases in a description that hint at derived or at own work.
WRAPPER_PHRASES = [
    "fork", "forked", "wrapper", "binding", "bindings", "bridge",
    "port", "ported", "clone", "based on", "built on top of",
    "thin wrapper", "sdk for", "client for",
]
ORIGINAL_PHRASES = [
    "from scratch", "original", "novel", "new approach", "reimplementation",
    "custom", "proprietary", "unique", "innovative", "ground up",
    "independent", "standalone",
]

# Category rules, tried in this order: (category, bonus, phrases, languages).
CATEGORY_RULES = [
    ("zk_system", 0.06, [
        "zkvm", "zk vm", "zero-knowledge", "zk proof", "proving system", "proof system",
        "recursive proof", "snark", "stark", "plonk", "zkp toolkit", "plonky",
        "snark verifier", "zk verifier", "groth16", "succinct proof",
    ], []),
    ("compiler_language", 0.06, [
        "smart contract language", "programming language for", "language for ethereum",
        "evm language", "solidity compiler", "vyper compiler",
        "formal verification language", "specification language", "certora",
    ], []),
    ("execution_client", 0.05, [
        "execution client", "ethereum client", "ethereum protocol",
        "c++ implementation of the ethereum", "rust implementation of the ethereum",
        "implementation of the ethereum protocol", "ethereum execution layer",
        "ethereum node", "evm-compatible", "full ethereum node",
    ], ["Go", "Rust", "C++", "C#", "Java", "Kotlin", "Elixir"]),
    ("consensus_client", 0.05, [
        "consensus client", "beacon client", "beacon chain client", "beacon node",
        "consensus layer", "ethereum consensus", "eth2 client", "proof-of-stake client",
    ], []),
    ("crypto_primitive", 0.05, [
        "bls12", "pairing-based", "elliptic curve library", "cryptographic library",
        "crypto library", "bls signatures", "assembly bls",
        "pure javascript cryptography", "pure typescript cryptography",
        "python elliptic", "python ecc", "javascript cryptography",
        "typescript cryptography",
    ], []),
    ("smart_contract", 0.02, [
        "smart contract library", "solidity library", "gas-optimized", "gas optimized",
        "account abstraction", "safe contracts", "multisig", "openzeppelin",
    ], []),
    ("spec_standard", 0.03, [
        "specification", "ethereum improvement proposal", "execution api",
        "consensus spec", "smart contract debugging data format",
        "networking specification", "libp2p spec", "api spec",
    ], []),
    ("dev_tooling", 0.01, [
        "development framework", "testing framework", "smart contract development",
        "solidity development", "ethereum development", "web3 development",
        "block explorer", "blockchain explorer", "static analysis", "linter",
        "formatter", "debugger", "symbolic execution", "fuzzer", "wallet library",
        "ethereum library", "deployment tool", "hardhat plugin", "block builder",
        "mev relay", "mev boost", "staking tool", "validator tool", "deposit cli",
        "abi", "contract verification", "source verification", "checkpoint sync",
    ], []),
    ("config_infra", -0.04, [
        "helm chart", "docker-compose", "docker setup", "kubernetes", "kurtosis",
        "docker configuration", "node setup", "run ethereum", "running ethereum",
        "set of helm", "multiple components", "dappnode",
    ], []),
    ("data_repo", -0.06, [
        "list of evm", "list of chains", "community-maintained list",
        "crowdsourced", "chain metadata", "chainlist", "network information",
    ], []),
]

# Project names whose category is known; they carry no bonus.
CATEGORY_BY_NAME = {
    "execution_client": [
        "erigon", "besu", "evmone", "ethrex", "helios", "juno", "taiko-mono",
    ],
    "consensus_client": ["nimbus-eth2", "prysm", "lambda_ethereum_consensus"],
    "compiler_language": ["solidity"],
    "zk_system": ["Plonky3", "rsp", "op-succinct", "snark-verifier", "lambdaworks"],
    "crypto_primitive": [
        "noble-curves", "py_ecc", "js-ethereum-cryptography", "bls", "gnark-crypto",
        "algebra",
    ],
    "smart_contract": [
        "openzeppelin-contracts", "safe-smart-account", "solady", "solidity-lib",
        "account-abstraction",
    ],
    "spec_standard": ["execution-apis", "libp2p"],
    "dev_tooling": [
        "hevm", "halmos", "foundry", "hardhat", "alloy", "ethers.js", "sourcify",
        "titanoboa", "edb", "goevmlab", "aderyn", "intellij-solidity", "mev-boost",
        "mev-boost-relay", "rbuilder", "stylus-sdk-rs", "remix-project",
        "trueblocks-core", "ethdo", "otterscan", "web3.py", "web3j",
        "commit-boost-client", "ethstaker-deposit-cli", "l2beat", "swiss-knife", "ape",
        "hardhat-deploy", "tevm-monorepo", "DefiLlama-Adapters", "blockscout",
        "scaffold-eth-2",
    ],
    "config_infra": [
        "checkpointz", "DAppNode", "eth-docker", "ethereum-package",
        "simple-optimism-node",
    ],
    "data_repo": ["chainlist", "chains"],
}
DEFAULT_CATEGORY = "general"

# Score ceilings per category.
CATEGORY_CAPS = {
    "data_repo": 0.50,
    "config_infra": 0.62,
    "dev_tooling": 0.74,
    "smart_contract": 0.75,
    "spec_standard": 0.75,
    "general": 0.75,
    "crypto_primitive": 0.78,
    "compiler_language": 0.78,
    "consensus_client": 0.78,
    "execution_client": 0.78,
    "zk_system": 0.78,
}
DEFAULT_CAP = 0.85
CAP_DECAY = 0.40
SCORE_FLOOR = 0.32
CONFIG_PENALTY = 0.08

# Weights of the score.
WEIGHTS = {
    "dep_weight": 0.35,
    "code_weight": 0.22,
    "contrib_weight": 0.06,
    "ai_scratch_coef": 0.06,
    "ai_wrapper_coef": -0.10,
    "ai_protocol_coef": 0.04,
    "ai_novel_coef": 0.03,
    "ai_found_coef": 0.08,
    "ai_template_coef": -0.04,
    "star_weight": 0.05,
    "activity_weight": 0.04,
    "usage_weight": -0.03,
    "producer_weight": 0.04,
    "consumer_weight": -0.04,
    "pc_ratio_weight": 0.02,
}
SCORE_BASE = 0.35
SCORE_SPAN = 0.55
SCORE_DIVISOR = 0.75
DEP_NORM_FLOOR = 400.0
CODE_NORM = 58165882
README_STEP = 0.02
README_LIMIT = 0.06
BENCH_BONUS = 0.02
SIGNAL_LIMIT = 0.15
NEIGHBOUR_NORM = 500

# Grid axes as (start, step, count).
GRID_DEP = (0.25, 0.03, 10)
GRID_WRAPPER = (-0.12, 0.02, 5)
GRID_CAP = (0.72, 0.02, 6)
GRID_USAGE = (-0.06, 0.02, 4)
GRID_CAP_CATEGORIES = [
    "execution_client", "consensus_client", "compiler_language", "zk_system",
    "crypto_primitive", "smart_contract", "spec_standard", "general",
]
CAP_AXES = {
    "zk_system": (0.72, 0.02, 9),
    "dev_tooling": (0.65, 0.02, 8),
    "config_infra": (0.40, 0.04, 8),
    "crypto_primitive": (0.72, 0.02, 9),
}
CAP_MIN_GAIN = 0.0005
CAP_PATIENCE = 500
CV_DEP = (0.28, 0.06, 4)
CV_WRAPPER = (-0.12, 0.04, 3)
OVERFIT_GAP = 0.04

# Source files.
SKIP_DIRS = [
    ".git", "node_modules", "vendor", "target", "dist", "build", "out", ".build",
    "_build", "generated", "gen", "third_party", "fixture", "fixtures", "testdata",
    "test_data",
]
CORE_DIRS = [
    "src", "lib", "core", "internal", "pkg", "crates", "cmd", "source", "main", "app",
]
TEST_WORDS = ["test", "spec", "mock", "bench", "example"]
EXTENSIONS = {
    "rust": ["rs"],
    "go": ["go"],
    "python": ["py"],
    "typescript": ["ts", "tsx"],
    "javascript": ["js", "jsx", "mjs", "cjs"],
    "solidity": ["sol"],
    "java": ["java"],
    "csharp": ["cs"],
    "cpp": ["cpp", "cc", "cxx", "h", "hpp"],
    "ruby": ["rb"],
    "nim": ["nim"],
    "kotlin": ["kt"],
    "haskell": ["hs"],
    "elixir": ["ex", "exs"],
}
LANGUAGE_LABELS = {
    "rust": "rust",
    "go": "go",
    "python": "python",
    "typescript": "typescript",
    "javascript": "javascript",
    "solidity": "solidity",
    "java": "java",
    "c#": "csharp",
    "c++": "cpp",
    "ruby": "ruby",
    "nim": "nim",
    "kotlin": "kotlin",
    "haskell": "haskell",
    "elixir": "elixir",
}
FILE_CAP = 2000
CORE_WEIGHT = 2.0
PLAIN_WEIGHT = 1.0
TEST_WEIGHT = 0.3

# Usage weights.
IMPORT_W = 1
ALIAS_W = 2
CALL_W = 3
CALL_CAP = 50
MANIFEST_BONUS = 3.0
DEV_BONUS = 0.9
DEV_FACTOR = 0.15
TEST_SHARE = 0.80
TEST_MIN_CALLS = 5
TEST_FACTOR = 0.5

# Affixes taken off a dependency's name, in this order.
NAME_AFFIXES = [
    "-rs", "-rust", "-go", "-py", "-js", "-ts",
    "rust-", "go-", "py-", "node-", "js-", "-lib", "-core",
]

# Manifest file names and their ecosystem, in listing order.
MANIFEST_KINDS = {
    "package.json": "npm",
    "Cargo.toml": "cargo",
    "go.mod": "go",
    "go.sum": "go",
    "requirements.txt": "pip",
    "setup.py": "pip",
    "setup.cfg": "pip",
    "pyproject.toml": "pip",
    "Pipfile": "pip",
    "Gemfile": "ruby",
    "pom.xml": "maven",
    "build.gradle": "gradle",
    "build.gradle.kts": "gradle",
    "mix.exs": "elixir",
    "cabal.project": "haskell",
    "stack.yaml": "haskell",
    "CMakeLists.txt": "cmake",
    "Makefile": "make",
    "flake.nix": "nix",
    "default.nix": "nix",
}
GRADLE_WORDS = [
    "implementation ", "implementation(", "api ", "api(",
    "compile ", "compile(", "runtimeOnly", "compileOnly",
]

# File tree statistics.
CI_PATHS = [
    ".github/workflows", ".circleci", ".travis.yml", "Jenkinsfile", ".gitlab-ci.yml",
]
TREE_SOURCE_EXT = [
    "py", "js", "ts", "go", "rs", "sol", "ex", "hs", "java", "kt", "c", "cpp", "h",
    "hpp", "cs", "rb", "nim", "vy", "fe", "jsx", "tsx", "mjs", "cjs",
]
TREE_CONFIG_EXT = [
    "yml", "yaml", "toml", "json", "ini", "cfg", "conf", "env", "xml", "lock",
]

# Model signals that enter the score, and the columns they come from.
SIGNALS = {
    "ai_scratch": "implements_from_scratch",
    "ai_protocol": "defines_new_protocol",
    "ai_novel": "has_novel_algorithms",
    "ai_wrapper": "is_wrapper_or_integration",
    "ai_found": "is_foundational_infrastructure",
    "ai_template": "is_template_or_scaffold",
    "ai_glue": "is_glue_code_or_middleware",
    "ai_utility": "is_utility_library_only",
}

# Markdown clean-up, applied in this order as (pattern, replacement).
MARKDOWN_STEPS = [
    (r"```[\s\S]*?```", " "),
    (r"`[^`\n]+`", " "),
    (r"<[^>]+>", " "),
    (r"!\[.*?\]\(.*?\)", " "),
    (r"\[([^\]]+)\]\([^\)]*\)", r"$1"),
    (r"(?m)^#{1,6}\s+", ""),
    (r"\*{1,3}([^*\n]+)\*{1,3}", r"$1"),
    (r"_{1,3}([^_\n]+)_{1,3}", r"$1"),
    (r"(?m)^[-*_]{3,}\s*$", ""),
    (r"https?://\S+", ""),
    (r"\[!\[.*?\].*?\]", ""),
    (r"\|[^\n]+\|", " "),
    (r"(?m)^[-|: ]+$", ""),
    (r"(?m)^[\s]*[-*+]\s+", ""),
    (r"\n{3,}", "\n\n"),
    (r"[ \t]{2,}", " "),
]
