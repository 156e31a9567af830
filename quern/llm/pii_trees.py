"""Boosted trees of pii.py as pii_train prints them: (feature, threshold, at most, more), leaves in thousandths."""

TREES = {
    "address": [  # held-out precision 0.991, recall 0.997 of 722 candidates
        ('length', 24, ('dots', 1, ('dots', 0, 875, -792), 879), ('last_label', 4, ('last_label', 3, 989, 724), -941)),
        ('length', 24, ('digits', 0, ('spelled', 1, -497, 868), 984), ('last_label', 4, ('last_label', 3, 676, 444), -645)),
        ('stop_inside', 0, ('separators', 3, ('bracket', 0, -615, 860), ('last_label', 3, 769, -191)), -649),
        ('stop_inside', 0, ('last_label', 4, ('separators', 3, -343, 536), -571), -580),
        ('last_label', 3, ('spelled', 0, ('stop_inside', 0, 689, -399), ('spelled', 1, -516, 478)), ('words', 3, ('digits', 0, -488, 424), 538)),
        ('stop_inside', 0, ('last_label', 4, ('length', 19, -242, 363), -472), -510),
        ('length', 27, ('last_label', 3, ('spelled', 0, 505, -337), ('separators', 3, 104, -437)), ('stop_inside', 0, 473, -271)),
        ('stop_inside', 0, ('length', 25, ('last_label', 2, 385, -187), ('last_label', 4, 445, -215)), -463),
        ('spelled', 1, ('spelled', 0, ('last_label', 3, 405, -167), -469), 435),
        ('stop_inside', 0, ('last_label', 4, ('spelled', 0, 255, -94), -361), -425),
        ('spelled', 1, ('spelled', 0, ('separators', 3, 611, -66), -426), 401),
        ('words', 3, ('last_label', 3, ('separators', 3, -226, 267), ('separators', 3, 264, -256)), 392),
        ('stop_inside', 0, ('separators', 5, ('last_label', 3, 200, -92), 475), -377),
        ('distinct', 16, ('length', 25, ('length', 24, -42, -521), ('last_label', 4, 314, -78)), ('hex_share', 22, ('length', 29, -287, 39), ('last_label', 4, 477, -67))),
        ('stop_inside', 0, ('separators', 5, ('spelled', 1, -33, 312), 423), -336),
        ('bracket', 0, ('length', 22, ('separators', 4, -324, -23), ('separators', 4, 10, 400)), ('separators', 4, 770, ('distinct', 13, 236, -274))),
    ],
    "number": [  # held-out precision 0.994, recall 0.945 of 1248 candidates
        ('number_cue', 0, ('zero_first', 0, ('hyphens', 1, -967, -684), ('length', 10, -897, 669)), 986),
        ('number_cue', 0, ('zero_first', 0, ('hyphens', 1, -650, -406), ('last_group', 7, 375, -982)), 672),
        ('number_cue', 0, ('zero_first', 0, ('hyphens', 1, -541, -262), ('length', 10, -675, 343)), ('length', 14, 585, 176)),
        ('number_cue', 0, ('bracket', 0, ('digits', 11, -240, -611), 1077), ('length', 14, 538, 135)),
        ('number_cue', 0, ('length', 10, -544, ('digits', 11, 515, -571)), ('length', 14, 508, 103)),
        ('number_cue', 0, ('length', 10, -517, ('last_group', 3, -436, 335)), ('length', 14, 484, 78)),
        ('digits', 11, ('length', 11, ('hyphens', 1, -408, 731), ('last_group', 3, 98, 990)), -559),
        ('digits', 11, ('length', 11, ('number_cue', 0, -298, 431), ('last_group', 3, 53, 735)), -536),
        ('zero_first', 0, ('hyphens', 1, ('first_group', 2, -552, -204), ('last_group', 3, -420, 791)), ('digits', 11, ('first_group', 1, -488, 489), -424)),
        ('digits', 11, ('digits', 8, ('number_cue', 0, -466, 232), ('first_group', 1, -377, 313)), -484),
        ('last_group', 3, ('zero_first', 0, -502, ('distinct', 8, 385, 50)), ('hex_share', 83, ('dots', 2, 661, -376), ('number_cue', 0, -291, 349))),
        ('zero_first', 0, ('last_group', 3, -470, ('hex_share', 83, 377, -329)), ('last_group', 7, ('length', 9, -183, 398), ('number_cue', 0, -322, 108))),
        ('digits', 10, ('digits', 9, ('hyphens', 1, -327, 256), ('first_group', 1, -325, 369)), ('hyphens', 0, ('second_group', 4, -411, 64), ('length', 14, 182, -123))),
        ('last_group', 3, ('zero_first', 0, -427, ('distinct', 8, 216, -16)), ('first_group', 2, ('dots', 0, 151, -375), ('digits', 11, 265, -306))),
        ('number_cue', 0, ('first_group', 3, ('first_group', 2, -193, 209), ('second_group', 4, -409, 241)), ('length', 14, 317, -44)),
        ('digits', 11, ('zero_first', 0, ('last_group', 3, -356, 83), ('length', 10, -121, 305)), -327),
    ],
    "secret": [  # held-out precision 1.000, recall 0.906 of 1632 candidates
        ('secret_cue', 0, ('lower', 0, ('account_cue', 0, 203, 973), ('separators', 1, -684, -997)), ('lower', 4, 333, 971)),
        ('separators', 1, ('changes', 1, ('upper', 0, -741, 380), ('hash_cue', 0, 637, -731)), -686),
        ('secret_cue', 0, ('account_cue', 0, ('separators', 1, -246, -590), 578), ('upper', 20, ('words', 3, 580, 260), ('digits', 6, 371, -116))),
        ('separators', 1, ('upper', 7, ('digits', 2, -580, 103), ('digits', 14, 725, 36)), -554),
        ('separators', 1, ('hash_cue', 0, ('changes', 2, -236, 447), -579), -530),
        ('separators', 1, ('upper', 8, ('secret_cue', 0, -174, 474), ('distinct', 17, -68, 608)), -513),
        ('slashes', 0, ('hash_cue', 0, ('length', 30, -8, 629), -509), -510),
        ('account_cue', 0, ('secret_cue', 0, ('lower', 17, -93, -440), ('lower', 25, 407, -26)), 517),
        ('separators', 1, ('upper', 9, ('account_cue', 0, -79, 476), 527), -482),
        ('separators', 1, ('hash_cue', 0, ('hex_share', 96, -22, 630), -451), -461),
        ('lower', 17, ('last_label', 2, ('account_cue', 0, -34, 438), ('separators', 1, 493, -106)), ('hex_share', 92, ('upper', 6, -490, 96), ('hash_cue', 0, 409, -291))),
        ('first_group', 15, ('first_group', 10, ('changes', 1, -350, 105), ('account_cue', 0, -681, 206)), ('hex_share', 94, 741, -103)),
        ('slashes', 0, ('distinct', 17, ('hex_share', 75, -413, 31), 487), -420),
        ('hash_cue', 0, ('hex_share', 96, ('last_group', 14, -99, 419), ('second_group', 8, 541, -112)), -418),
        ('account_cue', 0, ('last_label', 3, ('digits', 2, -384, -27), ('slashes', 0, 400, -167)), 389),
        ('hash_cue', 0, ('hex_share', 96, ('upper', 0, -377, 15), ('second_group', 8, 476, -87)), -378),
    ],
    "account": [  # held-out precision 1.000, recall 1.000 of 500 candidates
        ('checksum', 0, ('account_cue', 0, -982, 840), 992),
        ('checksum', 0, ('account_cue', 0, -669, 584), 679),
        ('checksum', 0, ('account_cue', 0, ('distinct', 15, -582, -155), 476), 585),
        ('checksum', 0, ('account_cue', 0, ('distinct', 15, -534, -118), 405), 540),
        ('checksum', 0, ('account_cue', 0, ('upper', 6, -505, -50), 349), 512),
        ('checksum', 0, ('account_cue', 0, ('last_label', 0, -480, 23), 301), 490),
        ('checksum', 0, ('account_cue', 0, ('hex_share', 52, 114, -455), 261), 468),
        ('checksum', 0, ('account_cue', 0, ('distinct', 15, -425, 156), 228), 443),
        ('checksum', 0, ('last_group', 1, ('second_group', 2, 330, -40), ('account_cue', 0, -396, 167)), 412),
        ('checksum', 0, ('last_group', 1, ('last_label', 0, -51, 292), ('account_cue', 0, -356, 149)), 377),
        ('checksum', 0, ('separators', 0, ('hex_share', 86, 279, -64), ('account_cue', 0, -311, 105)), 338),
        ('checksum', 0, ('hex_share', 52, ('distinct', 13, -38, 246), ('account_cue', 0, -298, 159)), 298),
        ('length', 19, ('checksum', 0, -191, 44), ('changes', 7, ('length', 29, 243, -3), ('checksum', 0, -61, 67))),
        ('checksum', 0, ('hex_share', 52, ('distinct', 13, -31, 195), ('account_cue', 0, -265, 121)), 238),
        ('length', 19, ('checksum', 0, -151, 34), ('length', 27, ('hex_share', 86, 198, 27), ('checksum', 0, -55, 68))),
        ('account_cue', 0, ('upper', 7, ('checksum', 0, -243, 93), 168), 198),
    ],
    "token": [  # held-out precision 1.000, recall 1.000 of 722 candidates
        ('separators', 0, ('changes', 1, -600, 993), -993),
        ('separators', 0, ('changes', 1, -412, 679), -679),
        ('separators', 0, ('changes', 1, -307, 586), -587),
        ('separators', 0, ('changes', 1, -233, 541), -542),
        ('separators', 0, ('changes', 1, -178, 513), -514),
        ('separators', 0, ('changes', 1, -136, 492), -494),
        ('separators', 0, ('changes', 1, -104, 471), -474),
        ('separators', 0, ('changes', 1, -79, 446), -451),
        ('separators', 0, ('first_group', 2, ('length', 22, 0, 463), ('changes', 1, -252, 177)), -423),
        ('words', 2, ('separators', 0, 459, -77), ('changes', 3, ('distinct', 25, -409, -6), ('separators', 0, 206, -80))),
        ('separators', 0, ('words', 2, 423, ('changes', 1, -212, 188)), -353),
        ('separators', 0, ('words', 3, ('length', 22, -24, 387), ('changes', 1, -160, 101)), -314),
        ('words', 2, ('separators', 0, 330, -40), ('changes', 3, ('distinct', 25, -304, -1), ('separators', 0, 137, -41))),
        ('separators', 0, ('last_group', 2, ('lower', 30, 289, -4), ('changes', 1, -106, 46)), -244),
        ('words', 2, ('separators', 0, 251, -31), ('changes', 3, ('distinct', 25, -244, -1), ('separators', 0, 105, -32))),
        ('separators', 0, ('first_group', 2, ('distinct', 13, -13, 225), ('changes', 1, -80, 36)), -190),
    ],
}

THRESHOLDS = {"address": -20, "number": 3347, "secret": 1285, "account": -2454, "token": -1855}
