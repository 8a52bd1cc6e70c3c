"""Venue strings with the label prefixes they must or must not give."""

CASES = [
    ("IEEE Transactions on Information Forensics and Security 19, 1-14", ["CCF A", "计算机科学TOP", "EI检索", "SCI升级版 计算机科学1区", "IF "]),
    ("Multimedia Systems 30 (6), 351", ["CCF C", "EI检索", "SCI升级版 计算机科学4区", "IF "]),
    ("IEEE transactions on pattern analysis and machine intelligence 44 (11), 7436-7456", ["CCF A", "SCI升级版 计算机科学1区"]),
    ("Proceedings of the IEEE/CVF Conference on Computer Vision and Pattern Recognition, 1-10", ["CCF A", "CORE A*"]),
    ("Proceedings of the IEEE/CVF International Conference on Computer Vision, 1-9", ["CCF A", "CORE A*"]),
    ("2023 IEEE International Conference on Robotics and Automation (ICRA), 123-130", ["CCF B", "CORE A*"]),
    ("Advances in Neural Information Processing Systems 36, 1-12", ["ML三大顶会", "CCF A", "CORE A*"]),
    ("International Conference on Machine Learning, 1000-1010", ["ML三大顶会", "CCF A", "CORE A*"]),
    ("Proceedings of the International Conference on Learning Representations, 1-12", ["ML三大顶会", "CCF A"]),
    ("ICML 2024 - Proceedings of the 41st International Conference on Machine …", ["ML三大顶会", "CCF A"]),
    ("Proceedings of the ACM Web Conference 2023, 1000-1010", ["CCF A", "CORE A*"]),
    ("Proceedings of the 29th ACM SIGKDD Conference on Knowledge Discovery and Data Mining", ["CCF A", "CORE A*"]),
    ("Proceedings of the VLDB Endowment 16 (4), 700-712", ["数据库四大", "CCF A", "CORE A*"]),
    ("Proceedings of the ACM on Management of Data 1 (2), 1-25", ["数据库四大", "CCF A", "CORE A*"]),
    ("Proceedings of the 2023 International Conference on Management of Data, 100-112", ["数据库四大", "CCF A"]),
    ("Proceedings of the 2023 ACM SIGMOD International Conference on Management of …", ["数据库四大", "CCF A"]),
    ("2023 IEEE 39th International Conference on Data Engineering (ICDE), 1-13", ["数据库四大", "CCF A", "CORE A*"]),
    ("Proceedings of the 42nd ACM SIGMOD-SIGACT-SIGAI Symposium on Principles of Database Systems, 1-12", ["数据库四大", "CCF B", "CORE A*"]),
    ("2022 IEEE International Conference on Mobile Data Management (MDM), 1-6", ["CCF C"]),
    ("arXiv preprint arXiv:2401.12345", ["arXiv"]),
    ("bioRxiv, 2023.01.01.522000", ["bioRxiv"]),
    ("medRxiv, 2023.05.01.23289000", ["medRxiv"]),
    ("SSRN Electronic Journal", ["SSRN"]),
    ("Research Square preprint", ["Research Square"]),
    ("32nd USENIX Security Symposium (USENIX Security 23), 1-18", ["CCF A", "CORE A*"]),
    ("Proceedings of the AAAI Conference on Artificial Intelligence 38 (5), 4321-4329", ["CCF A", "CORE A*"]),
    ("Proceedings of the 61st Annual Meeting of the Association for Computational Linguistics", ["CCF A", "CORE A*"]),
    ("ACM Transactions on Graphics (TOG) 42 (4), 1-15", ["CCF A", "SCI升级版 计算机科学1区"]),
    ("IEEE Internet of Things Journal 11 (3), 4000-4012", ["CCF C", "SCI升级版 计算机科学2区"]),
    ("Expert Systems with Applications 240, 122456", ["CCF C", "SCI升级版 计算机科学1区"]),
    ("Computers & Security 138, 103654", ["CCF B", "SCI升级版 计算机科学2区"]),
    ("Nature 615 (7951), 234-240", ["SCI升级版 综合性期刊1区"]),
    ("Proceedings of the IEEE/CVF Winter Conference on Applications of Computer Vision, 1-10", ["CORE A"]),
    ("International Conference on Artificial Intelligence and Statistics, 100-110", ["CORE A"]),
    ("ICASSP 2026-2026 IEEE International Conference on Acoustics, Speech and Signal Processing (ICASSP), 1-5", ["CCF B"]),
    ("ICASSP 2026-2026 IEEE International Conference on Acoustics, Speech and …", ["CCF B"]),
    ("ICASSP 2026 - 2026 IEEE International Conference on …", ["CCF B"]),
    ("CVPR 2024 - 2024 IEEE/CVF Conference on Computer Vision and Pattern …", ["CCF A", "CORE A*"]),
    ("IEEE Transactions on Information Forensics and Sec…", ["CCF A", "SCI升级版 计算机科学1区"]),
    ("Proceedings of the 61st Annual Meeting of the Association for Computational …", ["CCF A", "CORE A*"]),
    ("Proceedings of the 31st ACM International Conference on Multimedia, 1-10", ["CCF A", "CORE A*"]),
    ("2023 IEEE Symposium on Security and Privacy (SP), 1-19", ["CCF A", "CORE A*"]),
    ("Usenix Annual Technical Conference, 1-14", ["CCF A", "CORE A"]),
]
NEGATIVE = ["PhD thesis, Tsinghua University", "", "IEEE Transactions on …", "Proceedings of the …", "Journal of …"]
FORBIDDEN = [
    ("Proceedings of the IEEE/CVF Conference on Computer Vision and Pattern Recognition, 1-10", ["ML三大顶会", "数据库四大"]),
    ("Nature 615 (7951), 234-240", ["ML三大顶会", "数据库四大", "CCF", "CORE"]),
    ("International Conference on Neural Information Processing, 1-10", ["ML三大顶会"]),
    ("Advances in Neural Information Processing Systems 36, 1-12", ["数据库四大", "arXiv"]),
    ("arXiv preprint arXiv:2401.12345", ["CCF", "CORE", "SCI", "EI", "IF "]),
    ("2022 IEEE International Conference on Mobile Data Management (MDM), 1-6", ["数据库四大"]),
    ("Proceedings of the 2023 International Conference on Management of Data, 100-112", ["CCF C"]),
]
_GAP = " - "
BYLINES = [
    (_GAP.join(["J Hu, L Shen, G Sun", "IEEE transactions on pattern analysis and machine intelligence, 2019", "ieeexplore.ieee.org"]), ["CCF A", "计算机科学TOP", "SCI升级版 计算机科学1区"]),
    (_GAP.join(["N Shinn, F Cassano, A Gopinath…", "Advances in neural information processing systems, 2023"]), ["ML三大顶会", "CCF A", "CORE A*"]),
    (_GAP.join(["C Packer, S Wooders, K Lin, V Fang…", "arXiv preprint arXiv:2310.08560, 2023", "arxiv.org"]), ["arXiv"]),
    (_GAP.join(["J Smith-Jones, A Lee", "Nature, 2015", "nature.com"]), ["综合性期刊TOP", "SCI升级版 综合性期刊1区"]),
    (_GAP.join(["JS Park, J O'Brien, CJ Cai…", "Proceedings of the 36th annual ACM symposium on user interface software and technology, 2023", "dl.acm.org"]), ["CCF A", "CORE A*"]),
    (_GAP.join(["I Goodfellow, Y Bengio, A Courville", "2016", "books.google.com"]), []),
    ("Some Author Without Any Separator", []),
]
#: Our own: names that only token containment finds.
FUZZY = [("Joint ACM Symposium and Conference on Computer & Communications Security", ["CCF A", "CORE A*"]), ("International Workshop Conference on Mobile Systems Data Management", ["CCF C"])]
VENUES = sorted({v for v, _ in FUZZY} | {v for v, _ in CASES} | set(NEGATIVE) | {v for v, _ in FORBIDDEN})
