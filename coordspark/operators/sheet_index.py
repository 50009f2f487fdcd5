"""The index of map sheets, as values.

Sheets: Carta Geológica de Portugal 1:50 000 (division into sheets), LNEG, CC-BY 4.0; numbers of
the military map 1:25 000, series M888. Kilometres of the military grid.
"""

#: The grid's origin and the sizes of sheets.
ORIGIN, SIZE_25, SIZE_50 = (8, 0), (16, 10), (32, 20)
#: Runs of 1:25 000 sheets as row, first column, first number, count.
RUNS_25 = (
    (57, 11, 1, 1), (56, 9, 2, 4), (55, 8, 6, 4), (55, 17, 10, 4), (54, 8, 14, 13), (53, 8, 27, 13), (52, 8, 40, 14), (51, 8, 54, 14),
    (50, 8, 68, 14), (49, 8, 82, 14), (48, 8, 96, 13), (47, 8, 109, 13), (46, 9, 122, 11), (45, 9, 133, 10), (44, 9, 143, 10), (43, 9, 153, 10),
    (42, 9, 163, 10), (41, 8, 173, 11), (40, 8, 184, 11), (39, 8, 195, 11), (38, 8, 206, 11), (37, 8, 217, 11), (36, 8, 228, 11), (35, 8, 239, 10),
    (34, 8, 249, 11), (33, 7, 260, 12), (32, 7, 272, 12), (31, 7, 284, 12), (30, 7, 296, 11), (29, 7, 307, 9), (28, 6, 316, 10), (27, 6, 326, 11),
    (26, 5, 337, 12), (25, 5, 349, 12), (24, 5, 361, 13), (23, 5, 374, 14), (22, 5, 388, 14), (21, 5, 402, 13), (20, 4, 415, 14), (19, 4, 429, 13),
    (18, 6, 442, 11), (17, 6, 453, 11), (16, 6, 464, 11), (15, 8, 475, 9), (14, 8, 484, 10), (13, 8, 494, 11), (12, 8, 505, 11), (11, 8, 516, 10),
    (10, 8, 526, 9), (9, 8, 535, 9), (8, 8, 544, 8), (7, 8, 552, 8), (6, 8, 560, 8), (5, 8, 568, 8), (4, 8, 576, 8), (3, 8, 584, 8), (2, 7, 592, 9),
    (1, 7, 601, 8), (0, 7, 609, 1), (0, 12, 610, 3),
)
#: 1:25 000 sheets out of the runs as key, column, row.
SPECIAL_25 = (
    ("9A", 12, 55), ("9B", 13, 55), ("9C", 16, 55), ("67A", 22, 51), ("108A", 21, 48), ("142A", 19, 45), ("162A", 8, 42), ("205A", 19, 39),
    ("227A", 19, 37), ("227B", 7, 36), ("238A", 7, 35), ("248A", 18, 35), ("248B", 7, 34), ("306A", 18, 30), ("306B", 6, 29), ("315A", 16, 29),
    ("315B", 17, 29), ("325A", 16, 28), ("325B/C", 4, 27), ("325B/C", 5, 27), ("401A", 4, 21), ("441A", 17, 19), ("441B", 5, 18), ("483A", 17, 15),
    ("515A", 7, 11), ("525A", 18, 11), ("551A", 16, 8), ("583A", 7, 3),
)
#: 1:50 000 sheets as key, west and south edge, name.
SHEETS_50 = (
    ("1-A", 136, 560, "Valença"), ("1-B", 168, 560, "Monção"), ("1-C", 136, 540, "Caminha"), ("1-D", 168, 540, "Arcos de Valdevez"),
    ("2-A", 200, 560, "Portos"), ("2-C", 200, 540, "Tourém"), ("2-D", 232, 540, "Vilar de Perdizes"), ("3-C", 264, 540, "Vinhais"),
    ("3-D", 296, 540, "Espinhosela"), ("4-C", 328, 540, "Deilão"), ("5-A", 136, 520, "Viana do Castelo"), ("5-B", 168, 520, "Ponte da Barca"),
    ("5-C", 136, 500, "Barcelos"), ("5-D", 168, 500, "Braga"), ("6-A", 200, 520, "Montalegre"), ("6-B", 232, 520, "Chaves"),
    ("6-C", 200, 500, "Cabeceiras de Basto"), ("6-D", 232, 500, "Vila Pouca de Aguiar"), ("7-A", 264, 520, "Rebordelo"),
    ("7-B", 296, 520, "Bragança"), ("7-C", 264, 500, "Mirandela"), ("7-D", 296, 500, "Macedo de Cavaleiros"),
    ("8-A", 328, 520, "São Martinho de Angueira"), ("8-C", 328, 500, "Miranda do Douro"), ("9-A", 136, 480, "Póvoa de Varzim"),
    ("9-B", 168, 480, "Guimarães"), ("9-C", 136, 460, "Porto (esgota)"), ("9-D", 168, 460, "Penafiel (esgotada)"),
    ("10-A", 200, 480, "Celorico de Basto"), ("10-B", 232, 480, "Vila Real"), ("10-C", 200, 460, "Peso da Régua"), ("10-D", 232, 460, "Alijó"),
    ("11-A", 264, 480, "Vila Flor"), ("11-B", 296, 480, "Mogadouro"), ("11-C", 264, 460, "Torre de Moncorvo"), ("11-D", 296, 460, "Carviçais"),
    ("12-A", 328, 480, "Bemposta"), ("12-C", 328, 460, "Peredo da Bemposta"), ("13-A", 136, 440, "Espinho"), ("13-B", 168, 440, "Castelo de Paiva"),
    ("13-C", 136, 420, "Ovar"), ("13-D", 168, 420, "Oliveira de Azemeis"), ("14-A", 200, 440, "Lamego"), ("14-B", 232, 440, "Moimenta da Beira"),
    ("14-C", 200, 420, "Castro Daire"), ("14-D", 232, 420, "Aguiar da Beira"), ("15-A", 264, 440, "Vila Nova Foz Côa"),
    ("15-B", 296, 440, "Freixo de Espada à Cinta"), ("15-C", 264, 420, "Pinhel"), ("15-D", 296, 420, "Figueira de Castelo Rodrigo"),
    ("16-A", 136, 400, "Aveiro"), ("16-B", 168, 400, "Águeda"), ("16-C", 136, 380, "Vagos"), ("16-D", 168, 380, "Anadia"),
    ("17-A", 200, 400, "Viseu"), ("17-B", 232, 400, "Fornos de Algodres"), ("17-C", 200, 380, "Santa Comba Dão"), ("17-D", 232, 380, "Gouveia"),
    ("18-A", 264, 400, "Vila Franca das Naves"), ("18-B", 296, 400, "Almeida"), ("18-C", 264, 380, "Guarda"), ("18-D", 296, 380, "Nave de Haver"),
    ("19-A", 136, 360, "Cantanhede"), ("19-B", 168, 360, "Coimbra (Penacova)"), ("19-C", 136, 340, "Figueira da Foz"),
    ("19-D", 168, 340, "Coimbra (Lousã)"), ("20-A", 200, 360, "Tábua"), ("20-B", 232, 360, "Covilhã"), ("20-C", 200, 340, "Góis"),
    ("20-D", 232, 340, "Fundão"), ("21-A", 264, 360, "Sabugal"), ("21-B", 296, 360, "Quadrazais"), ("21-C", 264, 340, "Penamacor"),
    ("21-D", 296, 340, "Vale Feitoso"), ("22-B", 104, 320, "Vieira de Leiria"), ("22-D", 104, 300, "Marinha Grande"), ("23-A", 136, 320, "Pombal"),
    ("23-B", 168, 320, "Figueiró dos Vinhos"), ("23-C", 136, 300, "Leiria (esgotada)"), ("23-D", 168, 300, "Ferreira do Zêzere"),
    ("24-A", 200, 320, "Oleiros"), ("24-B", 232, 320, "Alcains"), ("24-C", 200, 300, "Sertã"), ("24-D", 232, 300, "Castelo Branco"),
    ("25-A", 264, 320, "Idanha-a-Nova"), ("25-B", 296, 320, "Salvaterra do Extremo"), ("25-C", 264, 300, "Retorta"), ("25-D", 296, 300, "Retorta"),
    ("26-B", 104, 280, "Alcobaça"), ("26-C", 72, 260, "Peniche"), ("26-D", 104, 260, "Caldas da Rainha (esgotada)"),
    ("27-A", 136, 280, "Vila Nova de Ourém"), ("27-B", 168, 280, "Tomar"), ("27-C", 136, 260, "Torres Novas"), ("27-D", 168, 260, "Abrantes"),
    ("28-A", 200, 280, "Mação"), ("28-B", 232, 280, "Nisa"), ("28-C", 200, 260, "Gavião"), ("28-D", 232, 260, "Castelo de Vide"),
    ("29-A", 264, 280, "Retorta"), ("29-C", 264, 260, "Marvão"), ("30-A", 72, 240, "Lourinhã"), ("30-B", 104, 240, "Bombarral (esgotada)"),
    ("30-C", 72, 220, "Torres Vedras"), ("30-D", 104, 220, "Alenquer (esgotada)"), ("31-A", 136, 240, "Santarém"), ("31-B", 168, 240, "Chouto"),
    ("31-C", 136, 220, "Corouche"), ("31-D", 168, 220, "Montargil"), ("32-A", 200, 240, "Ponte de Sôr"), ("32-B", 232, 240, "Portalegre"),
    ("32-C", 200, 220, "Avis"), ("32-D", 232, 220, "Sousel"), ("33-A", 264, 240, "Assumar"), ("33-C", 264, 220, "Campo Maior"),
    ("33-D", 296, 220, "Rio Xévora"), ("34-A", 72, 200, "Sintra"), ("34-B", 104, 200, "Loures"), ("34-C", 72, 180, "Cascais"),
    ("34-D", 104, 180, "Lisboa"), ("35-A", 136, 200, "Santo Estêvão"), ("35-B", 168, 200, "Mora"), ("35-C", 136, 180, "Santo Isidoro de Pegões"),
    ("35-D", 168, 180, "Montemor-o-Novo"), ("36-A", 200, 200, "Pavia"), ("36-B", 232, 200, "Estremoz"), ("36-C", 200, 180, "Arraiolos"),
    ("36-D", 232, 180, "Redondo"), ("37-A", 264, 200, "Elvas"), ("37-C", 264, 180, "Juromenha"), ("38-B", 104, 160, "Setúbal (esgotada)"),
    ("39-A", 136, 160, "Águas de Moura"), ("39-B", 168, 160, "Santiago do Escoural"), ("39-C", 136, 140, "Alcácer do Sal"),
    ("39-D", 168, 140, "Torrão"), ("40-A", 200, 160, "Évora"), ("40-B", 232, 160, "Reguengos de Monsaraz"), ("40-C", 200, 140, "Viana do Alentejo"),
    ("40-D", 232, 140, "Portel"), ("41-A", 264, 160, "Monsaraz"), ("41-C", 264, 140, "Mourão"), ("42-A", 136, 120, "Grandôla"),
    ("42-B", 168, 120, "Azinheira dos Barros"), ("42-C", 136, 100, "Santiago do Cacém"), ("42-D", 168, 100, "Aljustrel"), ("43-A", 200, 120, "Cuba"),
    ("43-B", 232, 120, "Moura"), ("43-C", 200, 100, "Beja"), ("43-D", 232, 100, "Serpa"), ("44-A", 264, 120, "Amareleja"),
    ("44-B", 296, 120, "Barrancos"), ("44-C", 264, 100, "Vila Verde de Ficalho"), ("45-A", 136, 80, "Cercal"), ("45-B", 168, 80, "Messejana"),
    ("45-C", 136, 60, "Odemira"), ("45-D", 168, 60, "Ourique"), ("46-A", 200, 80, "Castro Verde"), ("46-B", 232, 80, "Corte do Pinto"),
    ("46-C", 200, 60, "Almodôvar"), ("46-D", 232, 60, "Mértola"), ("47-A", 264, 80, "Rio Chança"), ("48-D", 104, 20, "Bordeira"),
    ("49-A", 136, 40, "Odeceixe"), ("49-B", 168, 40, "S. Marcos da Serra"), ("49-C", 136, 20, "Monchique"), ("49-D", 168, 20, "Silves"),
    ("50-A", 200, 40, "Ameixial"), ("50-B", 232, 40, "Alcoutim"), ("50-C", 200, 20, "S.Brás de Alportel"), ("50-D", 232, 20, "Castro Marim"),
    ("51-B", 104, 0, "Vila do Bispo"), ("52-A", 136, 0, "Portimão"), ("52-B", 168, 0, "Albufeira"), ("53-A", 200, 0, "Faro"),
    ("53-B", 232, 0, "Tavira"),
)
#: Other names of 1:50 000 sheets.
ALIASES_50 = {"44-CD": "44-C", "44-D": "44-C"}
