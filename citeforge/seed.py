"""A small synthetic seed of the catalogs, for tests and queries; not any official list.

Aliases and tags are the working tables of the product; entries are made up around them so that
each behaviour (collision, decoy, translation, dangling alias, hidden rank) has a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .operators.catalog import conference_index
from .operators.match import Catalogs, Options

#: Name in use -> abbreviation of the entry.
NAMES = [
    ("Advances in Neural Information Processing Systems", "NeurIPS"), ("Annual Conference on Neural Information Processing Systems", "NeurIPS"), ("Neural Information Processing Systems", "NeurIPS"),
    ("Proceedings of the ACM Web Conference", "WWW"), ("Proceedings of the Web Conference", "WWW"), ("The World Wide Web Conference", "WWW"), ("International World Wide Web Conference", "WWW"), ("World Wide Web Conference", "WWW"),
    ("Proceedings of the VLDB Endowment", "VLDB"), ("Very Large Data Bases", "VLDB"),
    ("ACM SIGMOD International Conference on Management of Data", "SIGMOD"), ("International Conference on Management of Data", "SIGMOD"), ("ACM on Management of Data", "SIGMOD"), ("Proceedings of the ACM on Management of Data", "SIGMOD"),
    ("ACM SIGMOD-SIGACT-SIGAI Symposium on Principles of Database Systems", "PODS"), ("Symposium on Principles of Database Systems", "PODS"),
    ("IEEE International Conference on Data Engineering", "ICDE"),
    ("ACM SIGKDD International Conference on Knowledge Discovery and Data Mining", "SIGKDD"), ("ACM SIGKDD Conference on Knowledge Discovery and Data Mining", "SIGKDD"), ("ACM SIGKDD International Conference on Knowledge Discovery & Data Mining", "SIGKDD"),
    ("ACM SIGCOMM Conference", "SIGCOMM"), ("Conference of the ACM Special Interest Group on Data Communication", "SIGCOMM"),
    ("ACM SIGGRAPH", "SIGGRAPH"), ("ACM SIGGRAPH Conference", "SIGGRAPH"), ("ACM Transactions on Graphics", "TOG"),
    ("USENIX Annual Technical Conference", "ACM SIGOPS ATC"), ("ACM SIGOPS Annual Technical Conference", "ACM SIGOPS ATC"),
    ("USENIX Symposium on Networked Systems Design and Implementation", "NSDI"), ("Symposium on Networked Systems Design and Implementation", "NSDI"),
    ("ACM SIGPLAN International Conference on Object-Oriented Programming, Systems, Languages, and Applications", "OOPSLA"), ("ACM SIGPLAN International Conference on Functional Programming", "ICFP"),
    ("ACM SIGSOFT International Symposium on the Foundations of Software Engineering", "FSE"), ("ACM Joint European Software Engineering Conference and Symposium on the Foundations of Software Engineering", "FSE"),
    ("IEEE/ACM International Conference on Automated Software Engineering", "ASE"), ("IEEE/ACM International Conference on Software Engineering", "ICSE"),
    ("IEEE Symposium on Security and Privacy", "S&P"), ("IEEE Symposium on Security and Privacy (SP)", "S&P"), ("ACM SIGSAC Conference on Computer and Communications Security", "CCS"), ("USENIX Security Symposium", "USENIX Security"), ("Network and Distributed System Security Symposium", "NDSS"),
    ("IEEE International Conference on Computer Vision", "ICCV"), ("IEEE/CVF International Conference on Computer Vision", "ICCV"), ("IEEE Conference on Computer Vision and Pattern Recognition", "CVPR"), ("IEEE/CVF Conference on Computer Vision and Pattern Recognition", "CVPR"), ("Computer Vision and Pattern Recognition", "CVPR"),
    ("AAAI Conference on Artificial Intelligence", "AAAI"), ("International Joint Conference on Artificial Intelligence", "IJCAI"),
    ("Annual Meeting of the Association for Computational Linguistics", "ACL"), ("Conference on Empirical Methods in Natural Language Processing", "EMNLP"), ("Conference of the North American Chapter of the Association for Computational Linguistics", "NAACL"),
    ("ACM International Conference on Multimedia", "ACM MM"), ("ACM Multimedia Conference", "ACM MM"),
    ("International Conference for High Performance Computing, Networking, Storage and Analysis", "SC"),
    ("ACM Conference on Human Factors in Computing Systems", "CHI"), ("CHI Conference on Human Factors in Computing Systems", "CHI"),
    ("IEEE International Conference on Computer Communications", "INFOCOM"), ("IEEE Conference on Computer Communications", "INFOCOM"),
]
#: Acronym in use -> abbreviation.
ACRONYMS = [("NIPS", "NeurIPS"), ("SP", "S&P"), ("PVLDB", "VLDB"), ("KDD", "SIGKDD"), ("ACMMM", "ACM MM"), ("ATC", "ACM SIGOPS ATC")]
#: Names for the core catalog alone.
CORE_NAMES = [
    ("IEEE/CVF Winter Conference on Applications of Computer Vision", "WACV"), ("Winter Conference on Applications of Computer Vision", "WACV"), ("IEEE Winter Conference on Applications of Computer Vision", "WACV"), ("Conference on Robot Learning", "CoRL"),
    ("Conference on Empirical Methods in Natural Language Processing", "EMNLP"), ("ACM SIGMOD-SIGACT-SIGAI Symposium on Principles of Database Systems", "PODS"), ("Symposium on Principles of Database Systems", "PODS"), ("Findings of the Association for Computational Linguistics", "ACL"),
]
#: Ccf abbreviation -> core abbreviation.
CCF_TO_CORE = [("SIGKDD", "KDD"), ("S&P", "SP"), ("ACM MM", "ACMMM"), ("USENIX Security", "USENIX-Security"), ("ACM SIGOPS ATC", "USENIX")]
DANGLING = [("names", "Conference on Nothing at All", "NOWHERE"), ("acronyms", "NIL", "NOWHERE"), ("core_names", "Workshop on Nothing", "NOWHERE")]

#: Tag groups.
TAGS = [
    (0, "ml-top3", "ML三大顶会", "NeurIPS / ICML / ICLR", "sr-tag-rose", ["NeurIPS", "ICML", "ICLR"], ["NeurIPS", "ICML", "ICLR"], ["Advances in Neural Information Processing Systems", "Conference on Neural Information Processing Systems", "Annual Conference on Neural Information Processing Systems", "International Conference on Machine Learning", "International Conference on Learning Representations"]),
    (1, "db-top4", "数据库四大", "SIGMOD / VLDB / ICDE / PODS", "sr-tag-bronze", ["SIGMOD", "VLDB", "ICDE", "PODS"], ["SIGMOD", "VLDB", "ICDE", "PODS"], ["ACM SIGMOD International Conference on Management of Data", "International Conference on Management of Data", "Proceedings of the ACM on Management of Data", "International Conference on Very Large Data Bases", "Proceedings of the VLDB Endowment", "IEEE International Conference on Data Engineering", "ACM SIGMOD-SIGACT-SIGAI Symposium on Principles of Database Systems"]),
]

#: Synthetic: abbr, name, ccf rank, core abbr, core name, core rank ('' where a catalog lacks it).
CONFERENCES = [
    ("NeurIPS", "Conference on Neural Information Processing Systems", "A", "NeurIPS", "Advances in Neural Information Processing Systems (was NIPS)", "A*"),
    ("ICML", "International Conference on Machine Learning", "A", "ICML", "International Conference on Machine Learning", "A*"),
    ("ICLR", "International Conference on Learning Representations", "A", "ICLR", "International Conference on Learning Representations", "A*"),
    ("WWW", "ACM The Web Conference", "A", "WWW", "ACM International World Wide Web Conference", "A*"),
    ("VLDB", "International Conference on Very Large Data Bases", "A", "VLDB", "International Conference on Very Large Databases", "A*"),
    ("SIGMOD", "ACM SIGMOD Conference", "A", "SIGMOD", "ACM Special Interest Group on Management of Data Conference", "A*"),
    ("PODS", "ACM SIGMOD Conference on Principles of DB Systems", "B", "PODS", "ACM SIGMOD-SIGACT-SIGART Conference on Principles of Database Systems", "A*"),
    ("ICDE", "IEEE International Conference on Data Engineering", "A", "ICDE", "International Conference on Data Engineering", "A*"),
    ("SIGKDD", "ACM SIGKDD Conference on Knowledge Discovery and Data Mining", "A", "KDD", "ACM International Conference on Knowledge Discovery and Data Mining", "A*"),
    ("SIGCOMM", "ACM International Conference on Applications, Technologies and Protocols for Computer Communication", "A", "SIGCOMM", "ACM Conference on Applications, Technologies and Protocols for Computer Communication", "A*"),
    ("SIGGRAPH", "ACM SIGGRAPH Annual Conference", "A", "SIGGRAPH", "ACM SIG International Conference on Computer Graphics and Interactive Techniques", "A*"),
    ("ACM SIGOPS ATC", "ACM SIGOPS Annual Technical Conference", "A", "USENIX", "Usenix Annual Technical Conference", "A"),
    ("NSDI", "Symposium on Network System Design and Implementation", "A", "NSDI", "Symposium on Networked Systems Design and Implementation", "A"),
    ("OOPSLA", "Conference on Object-Oriented Programming Systems Languages and Applications", "A", "OOPSLA", "ACM Conference on Object Oriented Programming Systems Languages and Applications", "A"),
    ("ICFP", "International Conference on Functional Programming", "B", "ICFP", "International Conference on Functional Programming", "A*"),
    ("FSE", "International Workshop on Fast Software Encryption", "B", "FSE", "Fast Software Encryption", "B"),
    ("FSE", "ACM International Conference on the Foundations of Software Engineering", "A", "FSE", "ACM International Conference on the Foundations of Software Engineering", "A*"),
    ("ASE", "International Conference on Automated Software Engineering", "A", "ASE", "Automated Software Engineering Conference", "A*"),
    ("ICSE", "International Conference on Software Engineering", "A", "ICSE", "International Conference on Software Engineering", "A*"),
    ("S&P", "IEEE Symposium on Security and Privacy", "A", "SP", "IEEE Symposium on Security and Privacy", "A*"),
    ("CCS", "ACM Conference on Computer and Communications Security", "A", "CCS", "ACM Conference on Computer and Communications Security", "A*"),
    ("USENIX Security", "USENIX Security Symposium", "A", "USENIX-Security", "Usenix Security Symposium", "A*"),
    ("NDSS", "Network and Distributed System Security Symposium", "A", "NDSS", "Usenix Network and Distributed System Security Symposium", "A*"),
    ("ICCV", "International Conference on Computer Vision", "A", "ICCV", "IEEE International Conference on Computer Vision", "A*"),
    ("CVPR", "IEEE/CVF Computer Vision and Pattern Recognition Conference", "A", "CVPR", "IEEE Conference on Computer Vision and Pattern Recognition", "A*"),
    ("AAAI", "AAAI Conference on Artificial Intelligence", "A", "AAAI", "National Conference of the American Association for Artificial Intelligence", "A*"),
    ("IJCAI", "International Joint Conference on Artificial Intelligence", "A", "IJCAI", "International Joint Conference on Artificial Intelligence", "A*"),
    ("ACL", "Annual Meeting of the Association for Computational Linguistics", "A", "ACL", "Association of Computational Linguistics", "A*"),
    ("EMNLP", "Conference on Empirical Methods in Natural Language Processing", "B", "EMNLP", "Empirical Methods in Natural Language Processing", "A*"),
    ("NAACL", "The Annual Conference of the North American Chapter", "B", "NAACL", "North American Association for Computational Linguistics", "A"),
    ("ACM MM", "ACM International Conference on Multimedia", "A", "ACMMM", "ACM Multimedia", "A*"),
    ("SC", "International Conference for High Performance Computing, Networking, Storage, and Analysis", "A", "SC", "ACM/IEEE International Conference for High Performance Computing", "A"),
    ("CHI", "ACM Conference on Human Factors in Computing Systems", "A", "CHI", "International Conference on Human Factors in Computing Systems", "A*"),
    ("INFOCOM", "IEEE International Conference on Computer Communications", "A", "INFOCOM", "Joint Conference of the IEEE Computer and Communications Societies", "A*"),
    ("UIST", "ACM Symposium on User Interface Software and Technology", "A", "UIST", "ACM Symposium on User Interface Software and Technology", "A*"),
    ("ICRA", "IEEE International Conference on Robotics and Automation", "B", "ICRA", "IEEE International Conference on Robotics and Automation", "A*"),
    ("ICASSP", "IEEE International Conference on Acoustics, Speech and Signal Processing", "B", "", "", ""),
    ("MDM", "International Conference on Mobile Data Management", "C", "MDM", "International Conference on Mobile Data Management", "B"),
    ("ICONIP", "International Conference on Neural Information Processing", "C", "ICONIP", "International Conference on Neural Information Processing", "B"),
    ("", "", "", "WACV", "IEEE Winter Conference on Computer Vision Applications", "A"),
    ("", "", "", "CoRL", "Conference on Robot Learning", "A"),
    ("", "", "", "AISTATS", "International Conference on Artificial Intelligence and Statistics", "A"),
    ("", "", "", "CCNAT", "National Conference on Computing Anything", "National"),
    ("", "", "", "AUSDM", "Australasian Data Mining Conference", "Australasian B"),
]
#: Synthetic: abbr, name, ccf rank ('' if not in ccf), cat, zone, top, impact, quartile, ei, warn.
JOURNALS = [
    ("TIFS", "IEEE Transactions on Information Forensics and Security", "A", "计算机科学", 1, 1, 8.0, "Q1", 1, None),
    ("", "Multimedia Systems", "C", "计算机科学", 4, None, 3.1, "Q2", 1, None),
    ("TPAMI", "IEEE Transactions on Pattern Analysis and Machine Intelligence", "A", "计算机科学", 1, 1, 18.6, "Q1", 1, None),
    ("TOG", "ACM Transactions on Graphics", "A", "计算机科学", 1, 1, 9.5, "Q1", 1, None),
    ("IoTJ", "IEEE Internet of Things Journal", "C", "计算机科学", 2, 1, 10.0, "Q1", None, None),
    ("ESWA", "Expert Systems with Applications", "C", "计算机科学", 1, 1, 7.5, "Q1", 1, None),
    ("", "Computers & Security", "B", "计算机科学", 2, None, 5.4, "Q1", None, None),
    ("", "Nature", "", "综合性期刊", 1, 1, 48.5, "Q1", None, None),
    ("", "IEEE Transactions on Image Processing", "", "计算机科学", 1, 1, 13.7, "Q1", 1, None),
    ("", "Journal of Empty Impact", "", "工程技术", 4, None, 0.0, "Q4", None, "高风险"),
    ("", "Letters without Category", "", None, 3, 1, 2.0, None, None, None),
]

ENTRY = "catalog string, ord int, abbr string, name string, rank string, type string, source string, field string, url string"
JOURNAL = "key string, n string, issn string, eissn string, wos string, cat string, zone int, top int, sub string, sub_zone int, impact double, quartile string, warn string, ei int"


def entry_rows() -> list[tuple]:
    ccf = [(a, n, r, "conference") for a, n, r, *_ in CONFERENCES if r] + [(a, n, r, "journal") for a, n, r, *_ in JOURNALS if r]
    rows = [("ccf", i, a, n, r, kind, "seed", "领域", "") for i, (a, n, r, kind) in enumerate(ccf)]
    return rows + [("core", i, a, n, r, "conference", "SEED", "", "") for i, (a, n, r) in enumerate(x[3:] for x in CONFERENCES if x[5])]


def alias_rows(dangling: bool = True) -> list[tuple]:
    rows = [(k, i, s, t) for k, xs in (("names", NAMES), ("acronyms", ACRONYMS), ("core_names", CORE_NAMES), ("ccf_to_core", CCF_TO_CORE)) for i, (s, t) in enumerate(xs)]
    return rows + [(k, 1000, s, t) for k, s, t in DANGLING if dangling]


def journal_frame(spark: SparkSession) -> DataFrame:
    from .functions import text as T

    rows = [(n, None, None, "SCIE", c, z, t, None, None, i, q, w, e) for _, n, _, c, z, t, i, q, e, w in JOURNALS]
    df = spark.createDataFrame(rows, JOURNAL.removeprefix("key string, "))
    return df.selectExpr(f"{T.normalize_name('n')} as key", "*")


def catalogs(spark: SparkSession, options: Options | None = None) -> Catalogs:
    """The seed as catalogs ready for lookup()."""
    entries = spark.createDataFrame(entry_rows(), ENTRY)
    aliases = spark.createDataFrame(alias_rows(), "kind string, ord int, src string, target string")
    tags = spark.createDataFrame(TAGS, "ord int, id string, label string, descr string, cls string, ccf array<string>, core array<string>, names array<string>")
    return Catalogs(conference_index(entries, aliases), journal_frame(spark), tags, options or Options()).ready()
