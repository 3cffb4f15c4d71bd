"""Word lists and patterns that results depend on."""

SECTIONS = ["abstract", "introduction", "related_work", "methods", "results", "discussion", "conclusion"]
COVERED_SECTIONS = ["abstract", "introduction", "methods", "results", "discussion", "conclusion"]
BOILERPLATE_SECTIONS = ["introduction", "related_work", "methods", "results", "discussion", "conclusion"]

# Heading patterns, in order of precedence.
HEADINGS = [
    (r"^\s*(?:\d+[\.\)]\s*)?(?:I{1,3}[\.\)]\s*)?(?:Abstract)\s*$", "abstract"),
    (r"^\s*(?:\d+[\.\)]\s*)?(?:I{1,3}[\.\)]\s*)?(?:Introduction|Intro\.)\s*$", "introduction"),
    (r"^\s*(?:\d+[\.\)]\s*)?(?:I{1,3}[\.\)]\s*)?(?:Related\s*Work|Background|Literature\s*Review|Prior\s*Work)\s*$", "related_work"),
    (r"^\s*(?:\d+[\.\)]\s*)?(?:I{1,3}[\.\)]\s*)?(?:Method(?:ology|s)?|Approach|Experimental\s*(?:Design|Setup|Section)|Computational\s*Details|Theory|Formulation|Model)\s*$", "methods"),
    (r"^\s*(?:\d+[\.\)]\s*)?(?:I{1,3}[\.\)]\s*)?(?:Results?(?:\s*and\s*Discussion)?|Experiments?(?:\s*and\s*Results?)?)\s*$", "results"),
    (r"^\s*(?:\d+[\.\)]\s*)?(?:I{1,3}[\.\)]\s*)?(?:Discussion|Analysis)\s*$", "discussion"),
    (r"^\s*(?:\d+[\.\)]\s*)?(?:I{1,3}[\.\)]\s*)?(?:Conclusion|Summary|Concluding\s*Remarks)\s*$", "conclusion"),
    (r"^\s*(?:\d+[\.\)]\s*)?摘要\s*$", "abstract"),
    (r"^\s*(?:\d+[\.\)]\s*)?引言|绪论|前言\s*$", "introduction"),
    (r"^\s*(?:\d+[\.\)]\s*)?相关工作|文献综述|研究背景\s*$", "related_work"),
    (r"^\s*(?:\d+[\.\)]\s*)?方法|实验方法|计算方法|理论|模型\s*$", "methods"),
    (r"^\s*(?:\d+[\.\)]\s*)?结果|实验结果|结果与讨论\s*$", "results"),
    (r"^\s*(?:\d+[\.\)]\s*)?讨论|分析\s*$", "discussion"),
    (r"^\s*(?:\d+[\.\)]\s*)?结论|总结\s*$", "conclusion"),
]
# Caption patterns (flags are added where they are used).
FIGURE_CAPTION_EN = r"(?:^|\n)\s*(?:Fig(?:ure)?[\.\s]+\d+[\.\s:]+)(.+?)(?=\n\s*(?:Fig(?:ure)?[\.\s]+\d+|Table[\.\s]+\d+|$))"
FIGURE_CAPTION_ZH = r"(?:^|\n)\s*(?:图\s*\d+[\.\s:：]+)(.+?)(?=\n\s*(?:图\s*\d+|表\s*\d+|$))"
TABLE_CAPTION_EN = r"(?:^|\n)\s*(?:Table[\.\s]+\d+[\.\s:]+)(.+?)(?=\n\s*(?:Fig(?:ure)?[\.\s]+\d+|Table[\.\s]+\d+|$))"
TABLE_CAPTION_ZH = r"(?:^|\n)\s*(?:表\s*\d+[\.\s:：]+)(.+?)(?=\n\s*(?:图\s*\d+|表\s*\d+|$))"

# Words that mark a problem statement.
PROBLEM_WORDS_EN = [
    "challenge", "remains unclear", "open question", "limitation",
    "however", "nevertheless", "remains elusive", "poorly understood",
    "needs further", "warrants further", "remains to be", "yet to be",
    "unsolved", "unresolved", "bottleneck", "obstacle", "drawback",
    "shortcoming", "gap", "remains a challenge", "remains challenging",
    "not well understood", "little is known", "lack of", "insufficient",
    "has not been", "have not been", "no systematic", "few studies",
]
PROBLEM_WORDS_ZH = [
    "挑战", "尚不清楚", "尚未解决", "有待", "仍不清楚",
    "瓶颈", "不足", "缺陷", "困难", "难题", "障碍",
    "鲜有", "缺乏", "尚无", "未解决", "尚未明确",
    "有待进一步", "尚需", "亟待", "亟需",
]
PROBLEM_LABEL_WORDS = ["challenge", "problem", "limitation", "remains", "however", "gap", "缺乏", "困难", "挑战", "问题"]

# Patterns of open questions, of their shorter alternative, and of research gaps.
QUESTION_PATTERNS = [
    r"(?:future\s*work|further\s*(?:investigation|study|research|exploration|development))",
    r"(?:remains?\s*(?:to\s*be|unclear|unknown|elusive|an?\s*open|poorly\s*understood|challenging))",
    r"(?:warrants?\s*(?:further|additional|more|continued))",
    r"(?:open\s*question|outstanding\s*(?:question|problem|challenge|issue))",
    r"(?:有待|尚待|仍需|需进一步|值得进一步|尚未|尚不|仍不|未来工作|展望|未解决)",
    r"(?:beyond\s*the\s*scope|outside\s*the\s*scope|not\s*considered|not\s*addressed)",
    r"(?:needs?\s*(?:further|more|additional|to\s*be)\s*(?:investigation|study|research|explored|examined))",
]
QUESTION_PATTERNS_SHORT = [
    r"(?:future\s*work|further\s*(?:investigation|study|research)|remains?\s*to\s*be|warrants?\s*further|open\s*question|outstanding\s*question)",
    r"(?:有待|尚待|仍需|需进一步|值得进一步|尚未|尚不|仍不|未来|展望)",
]
GAP_PATTERNS = [
    r"(?:has\s+not\s+(?:yet\s+)?been|have\s+not\s+(?:yet\s+)?been|remains?\s+(?:to\s+be|unclear|unknown|elusive|poorly\s+understood))",
    r"(?:lack\s+of|little\s+is\s+known|few\s+studies|no\s+(?:systematic|comprehensive|previous)\s+(?:study|investigation|work))",
    r"(?:further\s+(?:investigation|study|research|work)\s+(?:is|are)\s+(?:needed|required|necessary|warranted))",
    r"(?:有待|尚无|鲜有|缺乏|不足|仍需|尚需|亟待|亟需)",
]

# Words that vote for a missing section.
FILL_WORDS = {
    "methods": ["method", "approach", "algorithm", "implementation", "setup", "protocol", "procedure"],
    "results": ["result", "finding", "observation", "performance", "accuracy", "precision", "demonstrate", "show"],
    "discussion": ["discuss", "implication", "interpret", "explain", "mechanism", "insight", "suggest"],
    "conclusion": ["conclusion", "summary", "conclude", "summarize", "future work", "outlook", "perspective"],
}

# Method names looked for in full texts.
METHOD_WORDS = [
    "density functional theory", "DFT", "molecular dynamics", "Monte Carlo",
    "finite element", "FEM", "machine learning", "neural network",
    "deep learning", "ab initio", "first principles", "tight binding",
    "phase field", "kinetic Monte Carlo", "coarse grained",
    "X-ray diffraction", "XRD", "scanning electron microscopy", "SEM",
    "transmission electron microscopy", "TEM", "atomic force microscopy", "AFM",
    "X-ray photoelectron spectroscopy", "XPS", "Raman spectroscopy",
    "nuclear magnetic resonance", "NMR", "differential scanning calorimetry",
    "thermogravimetric analysis", "TGA", "FTIR", "UV-vis",
    "principal component analysis", "PCA", "singular value decomposition",
    "Fourier transform", "wavelet", "regression", "classification",
    "clustering", "Bayesian", "statistical", "error analysis",
    "第一性原理", "密度泛函", "分子动力学", "蒙特卡罗", "机器学习",
    "神经网络", "X射线衍射", "扫描电镜", "透射电镜", "拉曼光谱",
]

# Figure types with the words of their captions.
FIGURE_TYPES = [
    ("band structure", ["band structure", "band diagram", "dispersion", "band gap"]),
    ("density of states", ["density of states", "DOS", "PDOS", "partial density"]),
    ("XRD pattern", ["XRD", "X-ray diffraction", "diffraction pattern"]),
    ("SEM image", ["SEM", "scanning electron", "morphology"]),
    ("TEM image", ["TEM", "transmission electron", "HRTEM"]),
    ("AFM image", ["AFM", "atomic force"]),
    ("Raman spectrum", ["Raman", "Raman shift", "Raman spectroscopy"]),
    ("XPS spectrum", ["XPS", "X-ray photoelectron"]),
    ("FTIR spectrum", ["FTIR", "infrared", "IR spectrum"]),
    ("UV-vis spectrum", ["UV-vis", "ultraviolet-visible", "absorption spectrum"]),
    ("TGA/DSC", ["TGA", "DSC", "thermogravimetric", "differential scanning"]),
    ("crystal structure", ["crystal structure", "unit cell", "lattice"]),
    ("microstructure", ["microstructure", "grain", "texture", "morphology"]),
    ("phase diagram", ["phase diagram", "phase transition"]),
    ("schematic diagram", ["schematic", "diagram", "illustration"]),
    ("energy level diagram", ["energy level", "energy diagram", "band alignment"]),
    ("performance comparison", ["comparison", "benchmark", "comparison table"]),
    ("error/uncertainty", ["error bar", "uncertainty", "standard deviation"]),
    ("correlation plot", ["correlation", "scatter plot", "vs.", "versus"]),
    ("convergence test", ["convergence", "k-point", "cutoff energy", "basis set"]),
    ("能带结构", ["能带", "band structure", "色散"]),
    ("态密度", ["态密度", "DOS"]),
    ("XRD图谱", ["XRD", "衍射"]),
    ("SEM图像", ["SEM", "扫描电镜", "形貌"]),
    ("拉曼光谱", ["拉曼", "Raman"]),
    ("示意图", ["示意图", "schematic", "原理图"]),
    ("性能对比", ["对比", "comparison", "性能"]),
]

# Stop words of the two key-term rankings and of caption labels.
TERM_STOPS_METHOD = """
the a an is are was were be been being have has had do does did will would could should may might can shall to of in for on with at by from as into through during before after above below between
and but or nor not so than too very this that these those it its we they them their our
which who what when where how all each every both few more most other some such no only also used using based
my his her he she whom
""".split()
TERM_STOPS_INTRO = """
the a an is are was were be been being have has had do does did will would could should may might can shall to of in for on with at by from as into through during before after above below between
and but or nor not so than too very this that these those it its we they them their our
which who what when where how all each every both few more most other some such no only also used using based
however although therefore thus hence due since well
""".split()
CAPTION_STOPS = "a an the of in on at to for with and or is are was were be by from as this that it its".split()

# Words of key terms; arXiv ids as URL, prefixed, bare (new and old style), and their version.
TERM_WORDS = r"[a-zA-Z]{2,}(?:-[a-zA-Z]{2,})*"
ARXIV_URL = r"arxiv\.org/(?:abs|pdf)/([^/\s?#]+)"
ARXIV_PREFIX = r"arXiv:(\S+)"
ARXIV_BARE = r"^(\d{4}\.\d{4,5}(?:v\d+)?|[a-zA-Z.-]+/\d{7}(?:v\d+)?)$"
ARXIV_VERSION = r"v\d+$"
# DOI, arXiv number and year at the head of a text; what a title line doesn't begin with; spellings of a figure's number.
HEAD_DOI = r"(?:DOI|doi):\s*(\S+)"
HEAD_ARXIV = r"arXiv:(\d+\.\d+)"
HEAD_YEAR = r"(?:©|Copyright|Published).*?(20\d{2})"
NO_TITLE = ["http", "doi:", "DOI:", "arXiv:"]
FIGURE_NAMES = ["Figure ", "Fig. ", "Figure", "Fig", "图", "图 "]

# The common English stop list of 318 words.
ENGLISH_STOPS = """
a about above across after afterwards again against all almost alone along already also although always am among amongst amoungst amount an and
another any anyhow anyone anything anyway anywhere are around as at back be became because become becomes becoming been before beforehand behind being
below beside besides between beyond bill both bottom but by call can cannot cant co con could couldnt cry de describe detail do done down due during
each eg eight either eleven else elsewhere empty enough etc even ever every everyone everything everywhere except few fifteen fifty fill find fire
first five for former formerly forty found four from front full further get give go had has hasnt have he hence her here hereafter hereby herein
hereupon hers herself him himself his how however hundred i ie if in inc indeed interest into is it its itself keep last latter latterly least less
ltd made many may me meanwhile might mill mine more moreover most mostly move much must my myself name namely neither never nevertheless next nine no
nobody none noone nor not nothing now nowhere of off often on once one only onto or other others otherwise our ours ourselves out over own part per
perhaps please put rather re same see seem seemed seeming seems serious several she should show side since sincere six sixty so some somehow someone
something sometime sometimes somewhere still such system take ten than that the their them themselves then thence there thereafter thereby therefore
therein thereupon these they thick thin third this those though three through throughout thru thus to together too top toward towards twelve twenty
two un under until up upon us very via was we well were what whatever when whence whenever where whereafter whereas whereby wherein whereupon wherever
whether which while whither who whoever whole whom whose why will with within without would yet you your yours yourself yourselves
""".split()
