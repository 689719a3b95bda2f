"""Abbreviations of the domain and their expansions."""

#: Abbreviation and expansion, in the given order.
ABBREVIATIONS: dict[str, str] = {
    "УВ": "углеводороды",
    "НГБ": "нефтегазоносный бассейн",
    "НГО": "нефтегазоносная область",
    "НГР": "нефтегазоносный район",
    "НГКМ": "нефтегазоконденсатное месторождение",
    "НМ": "нефтяное месторождение",
    "ГМ": "газовое месторождение",
    "ГКМ": "газоконденсатное месторождение",
    "ОВ": "органическое вещество",
    "РОВ": "рассеянное органическое вещество",
    "ПАУ": "полициклические ароматические углеводороды",
    "ПАВ": "поверхностно-активные вещества",
    "ГФ": "газовый фактор",
    "КИН": "коэффициент извлечения нефти",
    "Ккат": "коэффициент катагенеза",
    "ВНК": "водонефтяной контакт",
    "ГВК": "газоводяной контакт",
    "ГНК": "газонефтяной контакт",
    "АВПД": "аномально высокое пластовое давление",
    "АНПД": "аномально низкое пластовое давление",
    "КВД": "кривая восстановления давления",
    "КПД": "кривая падения давления",
    "ПД": "пластовое давление",
    "ГД": "горное давление",
    "ФЕС": "фильтрационно-ёмкостные свойства",
    "Кп": "коэффициент пористости",
    "Кпр": "коэффициент проницаемости",
    "Кн": "коэффициент нефтенасыщенности",
    "Кв": "коэффициент водонасыщенности",
    "ГИС": "геофизические исследования скважин",
    "АК": "акустический каротаж",
    "ГК": "гамма-каротаж",
    "НГК": "нейтронный гамма-каротаж",
    "БК": "боковой каротаж",
    "МБК": "микробоковой каротаж",
    "ИК": "индукционный каротаж",
    "НК": "нейтронный каротаж",
    "КМВ": "кавернометрия",
    "КВ": "кривая восстановления",
    "МОВ": "метод отражённых волн",
    "МОГТ": "метод общей глубинной точки",
    "ОГТ": "общая глубинная точка",
    "ВСП": "вертикальное сейсмическое профилирование",
    "МПВ": "метод преломлённых волн",
    "3Д": "трёхмерная сейсморазведка",
    "2Д": "двухмерная сейсморазведка",
    "ОПЗ": "обработка призабойной зоны",
    "ГРП": "гидравлический разрыв пласта",
    "МУН": "методы увеличения нефтеотдачи",
    "НКТ": "насосно-компрессорные трубы",
    "ЭЦН": "электроцентробежный насос",
    "ШГН": "штанговый глубинный насос",
    "КРС": "капитальный ремонт скважины",
    "ПРС": "подземный ремонт скважины",
    "ЗБС": "зарезка бокового ствола",
    "Q": "четвертичный период",
    "N": "неогеновый период",
    "P": "палеогеновый период",
    "K": "меловой период",
    "K1": "нижний мел",
    "K2": "верхний мел",
    "J": "юрский период",
    "J1": "нижняя юра",
    "J2": "средняя юра",
    "J3": "верхняя юра",
    "T": "триасовый период",
    "P2": "пермский период поздняя пермь",
    "P1": "пермский период ранняя пермь",
    "C": "каменноугольный период",
    "D": "девонский период",
    "S": "силурийский период",
    "ТП": "тектоническое поднятие",
    "АВ": "антиклинальная ловушка",
    "ЛУ": "лицензионный участок",
    "ПАЗ": "периклинальная зона",
}
