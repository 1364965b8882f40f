"""Names that meet the rules of the name parsers one by one, with what each rule gives; put behind a part's words, so that every part has one."""

# A name, the level of its match, and its models.
MODEL_CASES: list[tuple[str, str | None, str]] = [
    ("JAWA 50 550-555", "type", "pionyr-550,pionyr-555"),
    ("JAWA 50 20-23", "type", "mustang-23,pionyr-20,pionyr-21"),
    ("JAWA 50 05,20-23", "type", "mustang-23,pionyr-05,pionyr-20,pionyr-21"),
    ("Jawa 50 555,05,20", "type", "pionyr-05,pionyr-20,pionyr-555"),
    ("Pionýr 550/555", "type", "pionyr-550,pionyr-555"),
    ("JAWA50 20/21/23", "type", "mustang-23,pionyr-20,pionyr-21"),
    ("Jawa Pionýr 23 Mustang", "type", "mustang-23"),
    ("Mustang", "nickname", "mustang-23"),
    ("JAWETTA 551", "type", "jawetta,jawetta-sport"),
    ("Jawetta", "nickname", "jawetta"),
    ("Jaweta Sport", "nickname", "jawetta-sport"),
    ("Jawa 50 typ 552", "type", "stadion-s11,stadion-s22,stadion-s23"),
    ("Stadion S22, Jawetta", "nickname", "jawetta,stadion-s22"),
    ("Stadion S 11/22, Jawetta ZN", "nickname", "jawetta,stadion-s11,stadion-s22"),
    ("JAWA 90, Cross, Roadster, Trail", "nickname", "jawa-90-cross-trail,jawa-90-roadster"),
    ("Jawa 90 typ 31", "type", "jawa-90-roadster"),
    ("JAWA 250/350 Pérák", "nickname", "perak-250,perak-350"),
    ("JAWA Pérák, 500 OHC", "nickname", "ohc-500,perak-250,perak-350"),
    ("Jawa 250/353 a 350/354", "type", "kyvacka-250,kyvacka-350"),
    ("JAWA 350 Kývačka, Panelka", "nickname", "kyvacka-350,panelka-350-360"),
    ("Jawa 250/350 Panelka 559/360", "type", "panelka-250-559,panelka-350-360"),
    ("JAWA Sport 590, 361", "type", "sport-250-590,sport-350-361"),
    ("JAWA 350 Californian", "nickname", "californian-362,sport-350-361"),
    ("Jawa Californian", "nickname", "californian-362,sport-250-590,sport-350-361"),
    ("JAWA 350 634-640", "type", "jawa-350-634,jawa-350-638,jawa-350-639,jawa-350-640"),
    ("JAWA 350 - 640", "type", "jawa-350-640"),
    ("Velorex 350 (3-kolový)", "nickname", "velorex-350"),
    ("ČZ 125 B,T", "type", "cz-125-b,cz-125-t"),
    ("ČZ 125/150C", "type", "cz-125-c,cz-150-c"),
    ("ČZ 125,175 typ 476, 477, 487, 488", "type", "cz-125-476,cz-125-488,cz-175-477,cz-175-487"),
    ("ČZ 125/175", "displacement", ""),
    ("ČZ 125 a 175", "displacement", ""),
    ("Čezeta 501.01 Prase", "type", "cezeta-501"),
    ("Čezetu 125", "brand", ""),
    ("Babetta 207 228 206", "type", "babetta-206,babetta-207,babetta-228"),
    ("Babetta134", "type", "babetta-134"),
    ("BABETTA STAR 134, STELLA", "nickname", "babetta-134"),
    ("BABETTA 40,25", "brand", ""),
    ("JAWA 350 OHC", "displacement", ""),
    ("JAWA 350 634, 350 OHC", "type", "jawa-350-634"),
    ("Jawa 350 Panelka, 634", "type", "jawa-350-634,panelka-350-360"),
    ("Jawa 350 354/06", "type", "kyvacka-350,panelka-350-360"),
    ("Jawa 350 typ 12", "type", "perak-350"),
    ("ČZ 125, 150 B, T, C", "type", "cz-125-b,cz-125-c,cz-125-t,cz-150-c"),
    ("(CZ)", None, ""),
    (",,ČZ 125 B", "type", "cz-125-b"),
    ("23z, 550 mm, 551, 552", None, ""),
    ("JAWA 350/12 Ogar *M", "type", "perak-350"),
    ("Jawa 350 OGAR, 59,00mm", "nickname", "perak-350"),
    ("Jawa 50 typ 20 Pionýr", "type", "pionyr-20"),
    ("Jawa 350 633/02 Bizon", "type", "jawa-350-633"),
    ("Jawa Bizon", "nickname", "jawa-250-623,jawa-350-633"),
    ("Jawa 632-640", "type", "jawa-350-632,jawa-350-634,jawa-350-638,jawa-350-639,jawa-350-640"),
    ("JAWA-ČZ 351, 352", "type", "jawa-cz-125-351,jawa-cz-150-352"),
]
# A name, its attributes as k=v in order of keys, and its tags.
OFFER_CASES: list[tuple[str, str, str]] = [
    ("Ráfek 1,50 x 16\" JAWA 50 - 550, 555 chrom", 'dimension=1.50x16";finish=chrome', ""),
    ("Paprsky M3 x 148mm chrom JAWA 50 - 555 (sada 36ks)", "dimension=m3x148mm;finish=chrome;pack=36ks", ""),
    ("Pístní kroužek 41,50x2mm SIMSON ,,CZ", "dimension=41.50x2mm", "origin-cz"),
    ("Tryska hlavní M5 x 0,75 - 80 Simson, Babetta - Dellorto", "dimension=m5x0.75-80;ref=dellorto", ""),
    ("Duše - 19\" x 2,25 - 2,50\" , Stadion, Jawetta", 'dimension=19"x2.25 2.50"', ""),
    ("Ráfek 16\" NEREZ - JAWA 50 05,20-23", 'dimension=16";finish=stainless', ""),
    ("Ložisko 6202 2RS", "dimension=6202-2rs", ""),
    ("Píst JAWA 50 - 05, 20, 21, 23 38,75 / 14,1 *Almet", "dimension=38.75/14.1", "mfr:almet"),
    ("Žárovka hlavního světla Babetta 6V 15W", "dimension=15w;voltage=6v", ""),
    ("Žárovka 12V 10W E10", "dimension=10w e10;voltage=12v", ""),
    ("Držák výfuk k navaření, PRAVÝ - JAWA Kývačka, Panelka", "side=right", ""),
    ("Kolena výfuku JAWA 350 Kývačka, Panelka - sada L+P", "pack=sada;side=both", ""),
    ("Silentblok předního a zadního tlumiče Jawa", "position=front+rear", ""),
    ("Sedlo Jawa Pérák - tmavě hnědé - ČR", "color=brown", "origin-cz"),
    ("Věnec Rozeta 56z ČZ Sport SK", "teeth=56", "origin-sk"),
    ("Pružiny skla paraboly Pérák - 4ks", "pack=4ks", ""),
    ("Pneu 3,25 - 16 *FORTUNE F-876", "code=f-876;dimension=3.25-16", "mfr:fortune"),
    ("Karburátor 2926 se sytičem JAWA, ČZ", "code=2926;with=s:sytic", ""),
    ("Přední blatník JAWA 550 (bez držáků)", "position=front;with=bez:drzak", ""),
    ("Ojnice úplná JAWA 50 - 20, 21, 23 *M", "pack=complete", "mfr:motomax"),
    ("Krytka řídítek Lakovaná JAWA 50", "finish=painted", ""),
    ("Pojistka keramická 16A", "dimension=16a", ""),
    ("Karburátor *DELLORTO PHBG 19DS ,,IT", "code=phbg19ds;ref=dellorto", "origin-it"),
    ("Pružina spojky JAWA Pérák/kývačka (standard) *M", "note=standard", "mfr:motomax"),
    ("Klika JAWA 50 (tuning)", "note=tuning", ""),
]
